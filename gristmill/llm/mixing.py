"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in an order by hash, one after the other, cut into blocks of equal length.
A target is an exact quota of blocks: whole passes over the source, and in one more pass the blocks whose place in a
pseudo-random permutation comes first (of the last of them only as many words as are still due). The quotas of all sources
are then split among output shards by a binary tree: at each node the left half of the shards draws its share without
replacement from the blocks of all sources (a multivariate hypergeometric draw), so every shard has the same size and
random, disjoint numbers of each source's blocks. A shard takes its blocks as a range of the permuted draws of a source,
and shuffles them locally by another hash.

What a document gives (``amounts``) is the sum of what the shards draw of it; the mix (``draws``) hands out the words too.

Only one row for each source, and one number for each source and shard (``MOST`` shards at most, so a shard grows with the
corpus), pass the driver; places of documents, blocks and draws are computed in parallel. The number of sources counts as a
dimension of the corpus: thousands, not one for each document.

Null text has size 0. A null source is a source of its own, the last. A source without words has target 0. Repeated rows are
documents of their own; which of two equal rows comes first doesn't show. Null ids are ordered by a hash of the text. A very long text is cut into blocks like any
other. An empty table gives an empty result. Columns that the mix adds take another name where ``docs`` has theirs. All draws come from hashes and a seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import LAST_ID, cut, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CEILING = 2.0
BLOCK = 512
SEED = 20240229
#: Rows of a source summed together, on average, and the most deals of a source, beyond which these rows grow.
DEAL = 2_000
DEALS = 1 << 16
#: Words of a shard, and the most shards.
SHARD = 1 << 17
MOST = 1 << 14


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """What each source gives. Weights repeat over the sources; a source stops at ``ceiling`` times its size, and what is beyond goes to the others by weight, until none is above."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    full: set[int] = set()
    total = share * sum(sizes)
    while True:
        rest, free = total - sum(ceiling * sizes[k] for k in sorted(full)), [k for k in range(len(sizes)) if k not in full]
        over = sum(weight[k] for k in free)
        above = {k for k in free if rest * weight[k] / over > ceiling * sizes[k]}
        if not above:
            return [ceiling * sizes[k] if k in full else rest * weight[k] / over for k in range(len(sizes))]
        full |= above


@dataclass(frozen=True)
class Quota:
    """What a source gives: ``passes`` whole passes and the first ``blocks`` blocks of the permutation, of the last one ``words`` words only."""

    passes: int
    blocks: int
    words: int
    total: int


def quota(size: int, target: float, block: int = BLOCK, salt: int = 0) -> Quota:
    words = round(target)
    if not size:
        return Quota(0, 0, 0, 0)
    passes, left = divmod(words, size)
    n = -(-size // block)
    short, at = size - (n - 1) * block, permuted(n - 1, n, salt)  # the source's last block, and its place
    if left == 0:
        return Quota(passes, 0, 0, n)
    before = lambda k: k * block - (block - short if at < k else 0)  # noqa: E731  words of the first k places
    k = left // block
    while before(k + 1) < left:
        k += 1
    while before(k) >= left:
        k -= 1
    return Quota(passes, k + 1, left - before(k), n)


#: Odd multipliers of a 64-bit mixing function.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _keys(salt: int) -> tuple[int, ...]:
    x, out = (SEED * 0x9E3779B97F4A7C15 + salt) & (1 << 64) - 1, []
    for _ in range(4):
        for m in MIX:
            x = ((x ^ x >> 33) * m) & (1 << 64) - 1
        out.append((x ^ x >> 33) & (1 << 31) - 1)
    return tuple(out)


def permuted(i: int, n: int, salt: int) -> int:
    """The place of block ``i`` of ``n``: a Feistel network over the next even power of two, walked until it falls below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, keys = (1 << half) - 1, _keys(salt)
    while True:
        left, right = i >> half, i & mask
        for k in keys:
            y = (right * 2654435761 + k) & (1 << 31) - 1
            left, right = right, left ^ ((y ^ y >> 15) * 2246822519 >> 16 & mask)
        i = left << half | right
        if i < n:
            return i


def _network(half: int, n: int, keys: tuple[int, ...]):
    def places(x):
        import numpy as np

        out, todo = x.astype(np.int64).copy(), np.arange(len(x))
        mask = (1 << half) - 1
        while len(todo):
            i = out[todo]
            left, right = i >> half, i & mask
            for k in keys:
                y = (right * 2654435761 + k) & (1 << 31) - 1
                left, right = right, left ^ ((y ^ y >> 15) * 2246822519 >> 16 & mask)
            out[todo] = left << half | right
            todo = todo[out[todo] >= n]
        return out

    return places


def split(quotas: list[int], shards: int, seed: int = SEED):
    """Of each shard (a row), how many draws of each source: the splitting tree."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        lo, hi, pool = todo.pop()
        if hi - lo == 1:
            out[lo] = pool
            continue
        mid, total = (lo + hi) // 2, int(pool.sum())
        drawn = _multivariate(rng, pool, total * (mid - lo) // (hi - lo))
        todo += [(mid, hi, pool - drawn), (lo, mid, drawn)]
    return out


#: Pools up to this size are drawn from by numpy, which is exact there.
NUMPY = 10**9


def _multivariate(rng, pool, sample: int):
    """A multivariate hypergeometric draw: source by source, each given those before."""
    import numpy as np

    rest = int(pool.sum())
    if rest < NUMPY:
        return rng.multivariate_hypergeometric(pool, sample, method="marginals")
    drawn = np.zeros(len(pool), np.int64)
    for k, n in enumerate(pool.tolist()):
        rest -= n
        drawn[k] = _hypergeometric(rng, n, rest, sample)
        sample -= int(drawn[k])
    return drawn


def _hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws are good.

    Pools beyond numpy's are inverted: probabilities by their ratios from the mode outwards, as far as a uniform number of 53
    bits can tell, which is some twelve deviations, or 20 numbers for each square root of the pool.
    """
    import numpy as np

    if good == 0 or sample == 0:
        return 0
    if good + bad < NUMPY:
        return int(rng.hypergeometric(good, bad, sample))
    n, low, high = good + bad, max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (n + 2), low), high)
    wide = 40 + int(12 * (sample * (good / n) * (bad / n) * ((n - sample) / max(1, n - 1))) ** 0.5)
    low, high = max(low, mode - wide), min(high, mode + wide)
    x = np.arange(low, high, dtype=np.float64)
    step = np.log((good - x) / (x + 1)) + np.log((sample - x) / (bad - sample + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def placed(docs: DataFrame, found: list[tuple]) -> DataFrame:
    """``docs`` (with ``doc_id``, ``h``, ``source`` and ``size``) with the columns of ``found`` and ``at``: the words before each row in its source's stream.

    A source's rows are dealt out by hash, into as many deals as its rows ask for, and summed within a deal; what comes
    before a deal is summed over a table of deals.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(k, s, n, float(t), q.passes, q.blocks, q.words, q.total, min(DEALS, -(-rows // DEAL))) for k, (s, n, t, q, rows) in enumerate(found)],
        "sid int, __source string, source_size long, target double, passes long, q_blocks long, q_words long, n_blocks long, n_deals long",
    )
    rows = docs.join(table, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("__o", F.xxhash64(F.lit(SEED), "doc_id", "size", "h")).withColumn("__deal", F.pmod("__o", "n_deals"))
    deals = rows.groupBy("sid", "__deal").agg(F.sum("size").alias("__n"))
    before = Window.partitionBy("sid").orderBy("__deal").rowsBetween(Window.unboundedPreceding, -1)
    deals = deals.select("sid", "__deal", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("sid", "__deal").orderBy("__o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return summed.join(deals, ["sid", "__deal"]).withColumn("at", F.col("at") + F.col("__before")).drop("__o", "__deal", "__before", "n_deals")


def sources(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block: int = BLOCK) -> list[tuple]:
    """Of each source: source, size, target, quota, rows; in the order of code points, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()  # a row for each source
    rows = sorted(((r.source, r.n, r.rows) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    goals = targets([n for _, n, _ in rows], weights, share, ceiling)
    return [(s, n, t, quota(n, t, block, k), m) for k, ((s, n, m), t) in enumerate(zip(rows, goals))]


def pieces(rows: DataFrame, found: list[tuple], block: int = BLOCK) -> DataFrame:
    """Each placed row cut at the borders of blocks: its words ``lo`` to ``hi``, the block's ``place`` in the permutation, and the ``words`` that one more pass takes."""
    whole = rows.where("size > 0").withColumn("b", F.expr(f"explode(sequence(at div {block}, (at + size - 1) div {block}))"))
    cuts = whole.withColumn("lo", F.greatest("at", F.col("b") * block) - F.col("at")).withColumn("hi", F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * block) - F.col("at"))
    place = _place(found)
    out = cuts.withColumn("place", place("b", "sid"))
    # of the block at the border, words count from its start
    some = F.greatest(F.lit(0), F.least("hi", F.col("b") * block + F.col("q_words") - F.col("at")) - F.col("lo"))
    return out.withColumn("words", F.when(F.col("place") < F.col("q_blocks") - 1, F.col("hi") - F.col("lo")).when(F.col("place") == F.col("q_blocks") - 1, some).otherwise(F.lit(0)))


def tree(found: list[tuple], shards: int | None = None):
    """The draws of each shard; as many shards as the words of the mix ask for, where their number isn't given."""
    if shards is None:
        shards = min(MOST, max(1, -(-round(sum(t for _, _, t, *_ in found)) // SHARD)))
    return split([q.passes * q.total + q.blocks for *_, q, _ in found], shards)


def dealt(rows: DataFrame, found: list[tuple], shards: int | None, block: int = BLOCK) -> DataFrame:
    """A row for each piece of a placed row that a shard draws: ``lo``, ``take`` words from there, ``shard`` and ``position``.

    Draws of a source are numbered pass by pass in permuted order; the tree gives each shard a range of them, and a hash puts
    the shard's blocks in order.
    """
    one = F.expr("explode(transform(sequence(0L, passes), p -> struct(p * n_blocks + place as draw, if(p < passes, hi - lo, words) as take)))")
    each = pieces(rows, found, block).withColumn("x", one).where("x.take > 0").withColumns({"draw": F.col("x.draw"), "take": F.col("x.take")})
    shard = _shard(rows.sparkSession.sparkContext.broadcast(_ends(tree(found, shards))))
    return each.withColumn("shard", shard("sid", "draw")).withColumn("position", F.xxhash64(F.lit(SEED), "sid", "draw"))


def _place(found: list[tuple]):
    """A vectorized function: the place of a block in its source's permutation."""
    networks = [(max(1, ((q.total - 1).bit_length() + 1) // 2), q.total, _keys(k)) for k, (*_, q, _) in enumerate(found)]

    def place(b, sid):
        import numpy as np
        import pandas as pd

        x, s = b.to_numpy(), sid.to_numpy()
        out = np.zeros(len(x), np.int64)
        for k in np.unique(s):
            on = s == k
            out[on] = _network(*networks[k])(x[on])
        return pd.Series(out)

    import pandas as pd

    place.__annotations__ = {"b": pd.Series, "sid": pd.Series, "return": pd.Series}
    return F.pandas_udf(place, "long")


def sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("h"))


def amounts(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block: int = BLOCK, shards: int | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document; taken: the words that the shards draw of it."""
    base = cut(sized(docs).withColumn("row", F.monotonically_increasing_id()))
    found = sources(base, weights, share, ceiling, block)
    rows = placed(base, found)
    drawn = dealt(rows, found, shards, block).groupBy("row").agg(F.sum("take").alias("taken"))
    return rows.join(drawn, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _ends(tree):
    """Of each source: where the draws of each shard end. A shard has a range of each source's draws."""
    import numpy as np

    return np.cumsum(tree, axis=0).T.copy()


def _shard(ends):
    """A vectorized function: the shard of a source's draw. ends: a broadcast of ``_ends``."""
    import numpy as np
    import pandas as pd

    def shard(sid, draw):
        s, d = sid.to_numpy(), draw.to_numpy()
        out = np.zeros(len(s), np.int32)
        for k in np.unique(s):
            on = s == k
            out[on] = np.searchsorted(ends.value[k], d[on], "right")
        return pd.Series(out)

    shard.__annotations__ = {"sid": pd.Series, "draw": pd.Series, "return": pd.Series}
    return F.pandas_udf(shard, "int")


def free(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from those taken (in any case of letters)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def draws(docs: DataFrame, shards: int | None = None, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block: int = BLOCK) -> DataFrame:
    """The mix: the columns of ``docs`` (text cut to the words drawn) and, last, ``shard``, ``position`` and ``start``, which get underscores behind their names where ``docs`` has these. A row for each piece of a document in a drawn block.

    All is computed on ids and sizes; a text is shuffled once to meet its pieces and split into words once. Repeated rows are
    told apart by their number within (doc_id, hash of the text).
    """
    text = F.col("text").cast("string")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("h")]
    narrow = docs.select(*key, F.col("source").cast("string").alias("source"), word_count(text).alias("size"))
    rows = cut(narrow.withColumn("n", F.row_number().over(Window.partitionBy("d", "h").orderBy("source"))).withColumn("doc_id", F.col("d")))
    found = sources(rows, weights, share, ceiling, block)
    mine = dealt(placed(rows, found), found, shards, block).groupBy("d", "h").agg(F.collect_list(F.struct("n", "lo", "take", "size", "shard", "position")).alias("all"))  # of one text
    flat = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    body, source = flat["text"], flat["source"]
    whole = docs.select(*key, *(F.col(f"`{c}`").alias(f) for c, f in flat.items())).withColumn("n", F.row_number().over(Window.partitionBy("d", "h").orderBy(source)))
    met = whole.join(mine, ["d", "h"]).withColumn("all", F.expr("filter(all, p -> p.n = n)"))
    parted = F.when(F.exists("all", lambda p: (p["lo"] != 0) | (p["take"] != p["size"])), F.regexp_extract_all(F.col(body), F.lit(r"\s*[^\x20\x09-\x0D]+"), F.lit(0)))
    words = met.select(*flat.values(), "all", F.explode(F.array(parted)).alias("w"))  # a generator, or each piece would split anew
    piece = f"if(p.lo = 0 and p.take = p.size, {body}, regexp_replace(array_join(slice(w, cast(p.lo as int) + 1, cast(p.take as int)), ''), '^\\\\s+', ''))"
    out = words.select(*flat.values(), F.expr(f"explode(transform(all, p -> struct({piece} as text, p.shard as shard, p.position as position, p.lo as start)))").alias("p"))
    added = zip(("shard", "position", "start"), free(["shard", "position", "start"], docs.columns))
    return out.select(*(F.col("p.text" if c == "text" else f).alias(c) for c, f in flat.items()), *(F.col(f"p.{c}").alias(name) for c, name in added))
