"""Names, identifiers, cells and cuts of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters behind a point that name an exchange, not a share class.
EXCHANGES = ("L", "T", "F", "V")


def ticker(x: Column) -> Column:
    """Upper case, a share class behind a dash: brk.b is BRK-B; SHOP.TO, VOD.L and 7203.T stay."""
    plain = F.replace(F.upper(F.trim(x)), F.lit("/"), F.lit("-"))
    root, letter = F.regexp_extract(plain, r"^(\p{L}{1,5})\.\p{L}$", 1), F.substring(plain, -1, 1)
    return F.when((root != "") & ~letter.isin(*EXCHANGES), F.concat(root, F.lit("-"), letter)).otherwise(plain)


def short_id(*parts: Column, length: int = 12) -> Column:
    """The first digits of a SHA-256 over parts, which a character that isn't in them keeps apart; NULL counts as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def slug(x: Column, most: int = 64) -> Column:
    """A directory name: letters, digits, dash and underscore; names that lose something, or are too long, end with eight digits of their hash."""
    raw = F.trim(x)
    plain = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9_-]+", "-"), "-{2,}", "-")
    trim = lambda c: F.regexp_replace(c, "^[-_]+|[-_]+$", "")
    mark = F.substring(F.sha1(raw), 1, 8)
    lossy = F.rlike(raw, F.lit(r"[^\x00-\x7f]")) | (F.length(trim(plain)) > most)
    short = F.concat(trim(F.substring(trim(plain), 1, most - 9)), F.lit("-"), mark)
    return F.when(raw == "", None).when(trim(plain) == "", F.concat(F.lit("strategy-"), mark)).when(lossy, short).otherwise(trim(plain))


def cell(x: Column) -> Column:
    """Text for a table cell in Markdown: one line, bars escaped, tags neutralized."""
    line = F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s+", " "))
    return F.replace(F.replace(line, F.lit("<"), F.lit("&lt;")), F.lit("|"), F.lit("\\|"))


def xml(x: Column) -> Column:
    """Text for an attribute or an element."""
    out = x
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def cut_at_sentence(x: Column, most: int) -> Column:
    """At most so many characters: to the last end of a sentence or paragraph, if it leaves half of them, else to the last space (if that does), with an ellipsis."""
    head = F.substring(x, 1, most)
    window = F.substring(x, 1, most + 1)
    ends = F.regexp_extract_all(window, F.lit(r"(?s)^(.*[.!?][\"')\]]*(?=\s|$)|.*?\S(?=\s*\n\s*\n))"), F.lit(1))
    best = F.rtrim(F.coalesce(F.try_element_at(ends, F.lit(1)), F.lit("")))
    short = F.substring(x, 1, most - 1)
    space = F.regexp_extract(short, r"(?s)^(.*) ", 1)
    rest = F.rtrim(F.when(F.length(space) >= (most - 1) // 2, space).otherwise(short))
    fits = (F.length(best) >= most // 2) & (F.length(best) <= most)
    return F.when(F.length(x) <= most, x).when(fits, best).when(F.lit(most > 1), F.concat(rest, F.lit("…"))).otherwise(head)


def safe(x: Column) -> Column:
    """A number that JSON can hold: NULL where it isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
