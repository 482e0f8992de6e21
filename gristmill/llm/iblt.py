"""Document fingerprints as invertible Bloom lookup tables, in SQL expressions only.

Paragraphs (lines) are hashed, long ones in pieces that end behind words whose hash says so, on average every ``PIECE`` words:
an inserted word changes the pieces around it and no others. With ``piece=None`` a line is one paragraph, however long. Each
distinct digest goes into three of 24 cells, which hold a count, the xor of the digests and the xor of their checks. Subtracting two tables leaves the digests that differ, and peeling
recovers them: a cell with one digest gives it away, which frees others. Where peeling stops short, the comparison is
retried larger: the digests are dealt out over many tables of 18 cells, with another seed, so that the work stays in
proportion. A table of these that can't be peeled gets 48 cells and then 63; if that fails too, all begins again with
twice as many tables. The likeness of two documents is the share of their
digests that is common: (n + m - differing) / (n + m); two empty texts have likeness 1. A retry needs the digests of both
documents: a stored fingerprint alone gives the likeness only of documents that differ in some 15 digests at most, which unrelated ones
don't. Digests are a set, so texts that hold the same pieces in another order or number have equal fingerprints.

The next document is found without one global sort: ids are cut into ranges by quantiles (an id with more than a range of rows
into ranges by the hash of the text), texts are dealt out by range, and the first row of a range is also sent to the end of
the range before it.

Null text is empty. Null ids come last; rows of equal ids follow each other by a hash of the text. A single row is its own
next. An empty table gives an empty result. Only doc_id and text are read, so other columns' names don't clash. A very long text is
compared by one task, in time that grows with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import LAST_ID, parts

CELLS = 24
ROUNDS = 14
RETRIES = 12
#: Digests for each table in a retry, at most on average.
LOAD = 5
#: Cells of each of those tables.
SMALL = 18
#: Cells of a table that couldn't be peeled, at its next tries.
LARGER = (48, 63)
#: Words of a piece of a line, on average.
PIECE = 24


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str, piece: int | None = PIECE) -> str:
    """Distinct digests of the paragraphs of a text."""
    lines = rf"filter(split({text}, '\\n'), x -> x != '')"
    if piece is None:
        return f"array_distinct(transform({lines}, x -> xxhash64(x)))"
    ends = f"filter(transform(ws, (w, i) -> if(i = size(ws) - 1 or pmod(xxhash64(w), {piece}) = 0, i + 1, 0)), e -> e > 0)"
    cuts = "transform(es, (e, i) -> if(i = 0, xxhash64(slice(ws, 1, e)), xxhash64(slice(ws, es[i - 1] + 1, e - es[i - 1]))))"
    return f"array_distinct(flatten(transform({lines}, x -> {_let('ws', "split(x, ' ')", _let('es', ends, cuts))})))"


def _check(k: str) -> str:
    return f"shiftrightunsigned(xxhash64({k}, 7919), 32)"


def _mask(v: str, cells: int = CELLS) -> str:
    """The three cells of a digest as bits, one in each third, from its hash under a seed."""
    third = cells // 3
    bit = lambda j: f"shiftleft({1 << j * third}L, cast(pmod(shiftrightunsigned({v}, {16 * j}) & 65535, {third}) as int))"
    return f"({bit(0)} | {bit(1)} | {bit(2)})"


def _entries(keys: str, sign: int, seed: str, tables: str, cells: int = CELLS) -> str:
    """Digests as entries: their table and cells first, by which they sort, then sign, digest and check."""
    entry = f"named_struct('t', cast(pmod(shiftrightunsigned(v, 48), {tables}) as int), 'p', {_mask('v', cells)}, 's', {sign}, 'k', k, 'c', {_check('k')})"
    return f"transform({keys}, k -> {_let('v', f'xxhash64(k, {seed})', entry)})"


def _cells(entries: str, cells: int = CELLS) -> str:
    return f"transform(sequence(0, {cells - 1}), i -> aggregate(filter({entries}, x -> (shiftrightunsigned(x.p, i) & 1L) = 1L), named_struct('n', 0, 'k', 0L, 'c', 0L), (a, x) -> named_struct('n', a.n + x.s, 'k', a.k ^ x.k, 'c', a.c ^ x.c)))"


def _peel(cells: str, seed: str, size: int = CELLS) -> str:
    """Of the cells of a difference: how many digests differ, or null where peeling stops short."""
    entry = f"named_struct('n', x.n, 'k', x.k, 'c', x.c, 'p', {_mask('v', size)})"
    pure = f"array_distinct(transform(filter(st.cells, x -> abs(x.n) = 1 and x.c = {_check('x.k')}), x -> {_let('v', f'xxhash64(x.k, {seed})', entry)}))"
    left = "aggregate(filter(q, y -> (shiftrightunsigned(y.p, i) & 1L) = 1L), x, (a, y) -> named_struct('n', a.n - y.n, 'k', a.k ^ y.k, 'c', a.c ^ y.c))"
    without = _let("m", "aggregate(q, 0L, (a, y) -> a | y.p)", f"transform(st.cells, (x, i) -> if((shiftrightunsigned(m, i) & 1L) = 0L, x, {left}))")
    step = _let("q", pure, f"if(size(q) = 0, named_struct('cells', st.cells, 'f', st.f, 'on', false), named_struct('cells', {without}, 'f', st.f + size(q), 'on', true))")
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'f', 0, 'on', true), (st, r) -> if(st.on, {step}, st), st -> if(forall(st.cells, x -> x.n = 0 and x.k = 0 and x.c = 0), st.f, cast(null as int)))"


def table(keys: str) -> str:
    """The cells of a document's fingerprint."""
    return _let("es", _entries(keys, 1, "0", "1"), _cells("es"))


def encoded(cells: str) -> str:
    """Cells as text: of each a count in 16 bits, a digest in 64, a check in 32."""
    return f"base64(unhex(array_join(transform({cells}, x -> concat(lpad(hex(x.n & 65535), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c), 8, '0'))), '')))"


def _larger(a: str, b: str, seed: str) -> str:
    """Differing digests by many tables; null where one of them can't be peeled, not even when it is made larger itself."""
    tables = f"cast(shiftleft(1L, {seed} - 1) * ((size({a}) + size({b})) div {LOAD} + 1) as int)"
    marks = "transform(sequence(0, nt), t -> named_struct('t', t, 'p', 0L, 's', 0, 'k', 0L, 'c', 0L))"  # one before each table's entries, and at the end
    every = f"sort_array(concat({_entries(a, 1, seed, 'nt', SMALL)}, {_entries(b, -1, seed, 'nt', SMALL)}, {marks}))"
    marked = "filter(transform(es, (e, i) -> if(e.s = 0, i, null)), i -> i is not null)"  # where the marks are, by table
    one = "slice(es, ts[t] + 2, ts[t + 1] - ts[t] - 1)"
    tries = [_peel(_cells("part", SMALL), seed, SMALL)]
    for k, cells in enumerate(LARGER):
        again = f"({seed} + {100 * (k + 1)})"
        moved = f"transform(part, x -> named_struct('p', {_mask(f'xxhash64(x.k, {again})', cells)}, 's', x.s, 'k', x.k, 'c', x.c))"
        tries.append(_let("es2", moved, _peel(_cells("es2", cells), again, cells)))
    each = f"transform(sequence(0, nt - 1), t -> {_let('part', one, f'if(size(part) = 0, 0, coalesce({", ".join(tries)}))')})"
    total = f"aggregate({each}, 0, (a, x) -> a + x)"  # null where one is null
    return _let("nt", tables, _let("es", every, _let("ts", marked, total)))


def differing(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """How many digests of two documents differ: by the fingerprints, then by larger and larger tables."""
    minus = f"zip_with({cells_a}, {cells_b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"
    retry = f"aggregate(sequence(1, {RETRIES}), cast(null as int), (d, seed) -> if(d is not null, d, {_larger(a, b, 'seed')}))"
    exact = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"  # after twelve failures, which no one will see
    return f"coalesce({_peel(minus, '0')}, {retry}, {exact})"


def likeness(a: str, b: str, different: str) -> str:
    n = f"(size({a}) + size({b}))"
    return f"if({n} = 0, 1.0D, cast({n} - {different} as double) / {n})"


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, text, next`` (the text of the next document)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("o", F.coalesce("doc_id", F.lit(LAST_ID)))
    n = ranges or 4 * parts(spark)
    raw = rows.agg(F.percentile_approx("o", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []  # n numbers
    bounds = sorted(set(raw))
    hot = sorted(x for x in bounds if raw.count(x) > 1)  # more rows than a range
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    b, s = f"array({', '.join(f'{x}L' for x in bounds)})", f"array({', '.join(map(str, steps))})"
    pid = f"aggregate({s}, 0, (p, s) -> if(p + s <= {len(bounds)} and try_element_at({b}, p + s) < o, p + s, p))" if bounds else "0"
    bits = n.bit_length()
    part = f"if(o in ({', '.join(f'{x}L' for x in hot)}), 1 + shiftrightunsigned(h ^ shiftleft(1L, 63), {64 - bits}), 0L)" if hot else "0L"
    # through a generator, or the optimizer would derive filters from the join that name columns of the other side
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("pid", F.explode(F.array(F.expr(f"{pid} * {(1 << bits) + 1}L + {part}"))))
    first = rows.groupBy("pid").agg(F.min(F.struct("o", "h")).alias("f"))  # a row for each range, whose number is known: in one task, and broadcast
    order = Window.partitionBy(F.lit(0)).orderBy("pid")
    first = first.select(F.col("pid").alias("id"), F.col("f.o").alias("fo"), F.col("f.h").alias("fh"), F.coalesce(F.lag("pid").over(order), F.max("pid").over(Window.partitionBy(F.lit(0)))).alias("prev"))
    mine = "struct(pid as pid, 0 as again)"
    sent = rows.join(F.broadcast(first), F.col("pid") == F.col("id")).withColumn("g", F.explode(F.expr(f"if(o = fo and h = fh, array({mine}, struct(prev as pid, 1 as again)), array({mine}))")))
    w = Window.partitionBy("gid").orderBy("again", "o", "h")
    dealt = sent.select(F.col("g.pid").alias("gid"), F.col("g.again").alias("again"), "o", "h", "doc_id", "text")
    return dealt.withColumn("next", F.lead("text").over(w)).where("again = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame, ranges: int | None = None, piece: int | None = PIECE) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; edited: the last quarter replaced by the beginning of the next document."""
    rows = with_next(docs, ranges).withColumn("n_chars", F.length("text").cast("long"))
    edited = "concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next, 1, cast(n_chars div 4 as int)))"
    rows = rows.select("doc_id", "n_chars", "text", "next", F.expr(edited).alias("edited"))
    # arrays are written out between the steps, or each use would compute them anew
    rows = _step(rows, ["doc_id", "n_chars", "sha2(edited, 256) as edited_sha256"], {"a": digests("text", piece), "e": digests("edited", piece), "z": digests("next", piece)})
    rows = _step(rows, ["doc_id", "n_chars", "edited_sha256", "a", "e", "z"], {"ca": table("a"), "ce": table("e"), "cz": table("z")})
    rows = _step(rows, ["doc_id", "n_chars", "edited_sha256", "a", "e", "z", "ca", "ce"], {"de": differing("a", "e", "ca", "ce"), "dz": differing("a", "z", "ca", "cz")})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(encoded("ca")).alias("fingerprint"), F.expr(encoded("ce")).alias("edited_fingerprint"),
        F.expr(likeness("a", "e", "de")).alias("near_edited"), F.expr(likeness("a", "z", "dz")).alias("near_next"),
    )


def _step(rows: DataFrame, kept: list[str], new: dict[str, str]) -> DataFrame:
    """Adds columns through a generator of one row, which the optimizer doesn't merge with what uses them."""
    one = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in new.items()) + ")"
    return rows.selectExpr(*kept, f"inline(array({one}))")
