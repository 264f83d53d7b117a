"""Near-duplicate texts by minhash, banding, verification and connected components.

1. Equal texts are one class, named by their hash.
2. The word shingles of a class give many minima under universal hash
   functions; runs of minima are hashed into bands.
3. Bands are routed by hash range as packed arrays, a few bytes an entry, and
   collisions are found by sorting numbers, not by joining rows.
4. A pair whose signatures agree in enough bands is verified exactly on its
   shingles.  Members of a crowded bucket are not all paired: they meet by a
   second band, and those of a bucket that is crowded then too are joined on
   the rarest of their shingles, which loses none that is alike.
5. Verified pairs are expanded to rows, or grouped by alternating large-star
   and small-star.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut, release, stage

#: Minima per band, bands, and bands in which two signatures must agree.
ROWS, BANDS, AGREE = 4, 96, 2
#: Entries of one hash range that a task takes at once, and ids of one bucket that are paired directly.
RANGE, CROWD = 1_000_000, 256
#: Ids of one packed batch; their places fit in two bytes.
BATCH = 40_000
#: The place that stands for those of a crowded key; none is as high.
FLAG = 2**16 - 1

_WORD = re.compile(r"[^\W_]+")


#: Word hashes already taken in this worker.
_HASHES: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``size`` words; a text with fewer words has none."""
    w = words(text)
    if len(w) < size:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > 1_000_000:
        _HASHES.clear()
    for x in w:
        if x not in _HASHES:
            _HASHES[x] = xxhash.xxh64_intdigest(x)
    h = np.fromiter(map(_HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
    out = h[: len(h) - size + 1].copy()
    for i in range(1, size):
        # Order matters: each word is mixed in after a rotation.
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
        out = (out ^ h[i : len(h) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def coefficients(count: int, seed: int) -> np.ndarray:
    """Odd 32-bit multipliers of the hash functions a*x mod 2**32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The minimum of a*x (mod 2**32) over the shingles' hashes, for each multiplier.

    Rows are taken a few at a time, so that the products stay in the cache.
    """
    folded = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    buffer = np.empty((32, len(a)), np.uint32)
    for i in range(0, len(folded), 32):
        part = folded[i : i + 32, None]
        np.multiply(part, a, out=buffer[: len(part)])
        np.minimum(out, buffer[: len(part)].min(0), out=out)
    return out


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    """For each signature (a row), one 64-bit key per run of ``rows`` minima, different for each band."""
    m = m.astype(np.uint64).reshape(len(m), -1, rows)
    key = np.arange(1, m.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows):
        key = (key ^ m[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def digest(text: str):
    """The name of a class of equal texts.  Unequal texts with the same words are found as pairs like any others."""
    return F.xxhash64(text)


def _wordy(text: str, size: int):
    """Whether a text has at least ``size`` words; the split stops there."""
    return F.size(F.filter(F.split(text, r"[^\p{L}\p{N}]+", size + 2), lambda w: w != "")) >= size


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each number, byte plane by byte plane, so that equal high bytes compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplanes(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<u8")


def _short(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, place in the range as four bytes) of each key."""
    step = np.uint64(2**64 // ranges + 1)
    r = keys // step
    return r.astype(np.int64), (keys - r * step) >> np.uint64(max(0, 32 - (ranges.bit_length() - 1)))


def colliding(texts: DataFrame, *, size: int, ranges: int, rows: int = ROWS, bands: int = BANDS, agree: int = AGREE, seed: int = 11, before: int = 0) -> DataFrame:
    """Collisions of the signatures of (id, text) rows; rows of one id have the same text.

    A row (a, b, null), a < b, for two ids that agree in ``agree`` bands or
    more.  A bucket of more than ``CROWD`` ids is not paired: it gives a row
    (a, null, key) for each of its ids.

    Entries travel as arrays, one binary row per batch and hash range: four
    bytes of key and two that are the id's place in the batch, whose ids travel
    once.  A key that is crowded within a batch leaves only a flag in its
    range; its ids go to other ranges, spread by batch, so no task gathers all
    ids of a hot key.  Pairs are many more than those that agree often enough,
    as unlike texts that share a phrase meet now and then; they travel as
    arrays too, to the partition that counts them, and are never written out.

    With ``before``, texts have an array ``crowds`` of the crowded keys that a
    call with so many ranges gave their ids, and ids meet only if they share a
    crowded key and another band.
    """
    a = coefficients(rows * bands, seed)

    def packed(held: dict[int, tuple], batch: int) -> pd.DataFrame:
        each, crowds = [m for m, _ in held.values()], [c for _, c in held.values()]
        keys = np.concatenate([band_keys(np.stack(each[i : i + 1024]), rows) for i in range(0, len(each), 1024)])
        own = np.repeat(np.arange(len(each)), bands)
        if before:
            many = np.array([len(c) for c in crowds])
            shared, keys, own = np.concatenate(crowds).astype(np.int64), np.repeat(keys, many, axis=0), np.repeat(own.reshape(-1, bands), many, axis=0)
            r, short = _short(keys, before)
            others = short.astype(np.int64) + (r << 40) != shared[:, None]
            keys = ((keys ^ (shared.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) * np.uint64(0xFF51AFD7ED558CCD))[others]
            keys, own = keys ^ (keys >> np.uint64(32)), own[others]
            keys *= np.uint64(0xC2B2AE3D27D4EB4F)
        keys = keys.ravel()
        at = np.argsort(keys)
        keys, own = keys[at], own[at]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.r_[start, len(keys)])
        out, single = [(ranges + batch % ranges, batch, None, np.fromiter(held, dtype=np.int64, count=len(held)).tobytes())], np.ones(len(keys), bool)
        for n in np.flatnonzero(length > CROWD):
            lo, hi = start[n], start[n] + length[n]
            r, short = _short(keys[lo : lo + 1], ranges)
            out.append((ranges + (batch + int(n)) % ranges, batch, (short.astype(np.int64) + (r << 40)).tobytes(), (own[lo:hi] + (batch << 16)).tobytes()))
            own[lo], single[lo + 1 : hi] = FLAG, False
        keys, own = keys[single], own[single]
        part, short = _short(keys, ranges)
        edges = np.searchsorted(part, np.arange(ranges + 1))
        for r, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if hi > lo:
                out.append((r, batch, _planes(short[lo:hi], 4), _planes(own[lo:hi], 2)))
        return pd.DataFrame(out, columns=["r", "batch", "keys", "local"])

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        # Numbers of batches: the partition in the lower bits, as few bytes then differ.
        batch, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for i, t, c in zip(pdf["id"], pdf["text"], pdf["crowds"] if before else [None] * len(pdf)):
                if i not in held and len(x := shingles(t, size)):
                    held[i], n = (minima(x, a), c), n + (len(c) if before else 1)
                    if n >= BATCH:
                        yield packed(held, batch)
                        held, batch, n = {}, batch + (1 << 20), 0
        if held:
            yield packed(held, batch)

    def sent(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        """Pairs as arrays, one row per partition that counts."""
        to = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        to = ((to ^ (to >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(ranges)
        at = np.lexsort((x, to))
        to, x, y = to[at], x[at], y[at]
        edges = np.searchsorted(to, np.arange(ranges + 1, dtype=np.uint64))
        out = [(n, None, _planes(x[lo:hi], 6), _planes(y[lo:hi], 6)) for n, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        return pd.DataFrame(out, columns=["r", "batch", "keys", "local"]).astype({"batch": "Int64"})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition is one range, with the names of some batches and the ids of some crowded keys.
        held = [x for x in batches if len(x)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        marked = pdf["r"] >= ranges
        if marked.any():
            yield pdf[marked]
        pdf = pdf[~marked]
        if not len(pdf):
            return
        r = int(pdf["r"].iloc[0])
        keys = np.concatenate([_unplanes(x, 4) for x in pdf["keys"]])
        place = [_unplanes(x, 2).astype(np.int64) for x in pdf["local"]]
        ids = np.concatenate([np.where(p == FLAG, -1, p + (int(n) << 16)) for p, n in zip(place, pdf["batch"])])
        at = np.lexsort((ids, keys))
        keys, ids = keys[at], ids[at]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
        keys, ids = keys[new], ids[new]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.r_[start, len(keys)])
        # The flag is the lowest id, so it comes first.
        hot = (length > CROWD) | (ids[start] < 0)
        for n in np.flatnonzero(hot):
            own = ids[start[n] : start[n] + length[n]]
            if len(own := own[own >= 0]):
                yield pd.DataFrame({"r": [ranges + r], "batch": pd.array([None], "Int64"), "keys": [(keys[start[n]].astype(np.int64) + (r << 40)).tobytes()], "local": [own.tobytes()]})
        pair, ready, n = np.where(hot, 0, length), [], 0
        for gap in range(1, int(pair.max(initial=1))):
            at = np.flatnonzero(pair > gap)
            many = pair[at] - gap
            first = np.repeat(start[at], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            ready.append((ids[first], ids[first + gap]))
            n += len(first)
            if n > RANGE:
                yield sent(*map(np.concatenate, zip(*ready)))
                ready, n = [], 0
        if ready:
            yield sent(*map(np.concatenate, zip(*ready)))

    def frame(x: np.ndarray, y: np.ndarray | None, crowd: int | None, name: np.ndarray | None = None) -> pd.DataFrame:
        none = pd.array([None] * len(x), "Int64")
        full = pd.array(np.full(len(x), crowd or 0), "Int64")
        return pd.DataFrame({"a": x, "b": none if y is None else pd.array(y, "Int64"), "crowd": none if crowd is None else full, "name": none if name is None else pd.array(name, "Int64")})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = [], []
        for pdf in batches:
            for r, batch, key, local in pdf.itertuples(index=False):
                if r < ranges:
                    x.append(_unplanes(key, 6))
                    y.append(_unplanes(local, 6))
                elif key is None:
                    name = np.frombuffer(local, np.int64)
                    yield frame(np.arange(len(name)) + (int(batch) << 16), None, None, name)
                else:
                    yield frame(np.frombuffer(local, np.int64), None, int(np.frombuffer(key, np.int64)[0]))
        if x:
            p, q = np.concatenate(x).astype(np.int64), np.concatenate(y).astype(np.int64)
            at = np.lexsort((q, p))
            p, q = p[at], q[at]
            start = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            often = start[np.diff(np.r_[start, len(p)]) >= agree]
            yield frame(p[often], q[often], None)

    columns = "r int, batch long, keys binary, local binary"
    # Each range is a partition of its own, so their number grows with the input and their size does not; names and crowds follow modulo.
    met = texts.select("id", "text", *["crowds"] * bool(before)).mapInPandas(sign, columns).repartitionById(ranges, "r").mapInPandas(meet, columns)
    met = stage(met.repartitionById(ranges, "r").mapInPandas(count, "a long, b long, crowd long, name long"), "met")
    release(texts.sparkSession)
    # A text may stand in several batches; the names of their places make its pairs one.
    named = met.where("name is not null")
    left, right = (named.select(F.col("a").alias(c), F.col("name").alias(f"{c}_id")).hint("merge") for c in "ab")
    pairs = met.where("b is not null").select("a", "b").join(left, "a").join(right, "b").where("a_id <> b_id")
    pairs = pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.lit(None).cast("long").alias("crowd")).distinct()
    crowd = met.where("crowd is not null").select("a", "crowd").join(left, "a").select(F.col("a_id").alias("a"), F.lit(None).cast("long").alias("b"), "crowd").distinct()
    return pairs.unionByName(crowd)


def jaccard(x: set, y: set) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def _grams(text: str, size: int) -> set:
    w = words(text)
    return set(zip(*(w[i:] for i in range(size))))


def similar_classes(texts: DataFrame, threshold: float, size: int, rows: int = ROWS, bands: int = BANDS, agree: int = AGREE) -> DataFrame:
    """(a, b, likeness), a < b: ids of (id, text) rows whose shingle sets are alike by ``threshold`` or more."""
    n = texts.count()
    ranges = max(12, n * bands // RANGE)
    met = stage(colliding(texts, size=size, ranges=ranges, rows=rows, bands=bands, agree=agree), "pairs")
    pairs = met.where("crowd is null").select("a", "b")
    crowd = met.where("crowd is not null").select(F.col("a").alias("id"), "crowd")
    if agree > 1 and (many := crowd.count()):
        # Most of a crowd only share a phrase: its members meet by a second band, and those of a bucket that is crowded then too are alike.
        keys = stage(crowd.groupBy("id").agg(F.collect_list("crowd").alias("crowds")), "crowds")
        again = _of(texts, keys.select("id")).join(keys.hint("merge"), "id")
        met = colliding(again, size=size, ranges=max(12, many * bands // RANGE), rows=rows, bands=bands, agree=agree - 1, before=ranges)
        met = stage(met, "crowded")
        pairs = pairs.unionByName(met.where("crowd is null").select("a", "b")).distinct()
        crowd = met.where("crowd is not null").select(F.col("a").alias("id"))
    crowd = crowd.select("id").distinct()
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_prefix_pairs(_of(texts, stage(crowd, "crowd")), threshold, size)).distinct()
    pairs = stage(pairs, "candidates")
    one = _of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    first = pairs.join(one.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(one.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[int, set] = {}
            score = []
            for a, b, ta, tb in pdf.itertuples(index=False):
                for i, t in ((a, ta), (b, tb)):
                    if i not in known:
                        known[i] = _grams(t, size)
                score.append(jaccard(known[a], known[b]))
            out = pdf[["a", "b"]].assign(likeness=np.array(score, dtype=float))
            yield out[out["likeness"] >= threshold]

    return both.mapInPandas(verify, "a long, b long, likeness double")


#: Ids that are sent to every task at most (eight bytes each); more are joined by a shuffle.
NAMED = 1_000_000


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text), once for each of ``ids``; where these are few, other texts are dropped before any shuffle."""
    known = ids if ids.count() > NAMED else F.broadcast(ids)
    return texts.join(known, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def _prefix_pairs(texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b), a < b: candidates among the ids of crowded buckets, of which none that is alike is missing.

    Pairing all members of a crowd would be quadratic.  Two sets that are
    alike by t share a member among the first |x| - ceil(t |x|) + 1 of each in
    any common order.  In the order of rising frequency these are the rarest,
    so what a crowd has in common doesn't bring its members together, but what
    a few of them share does.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "grams": [shingles(t, size).astype(np.int64) for t in pdf["text"]]})

    grams = stage(texts.mapInPandas(cut_up, "id long, grams array<long>"), "grams")
    each = grams.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("often")).where(F.col("often") > 1)
    order = Window.partitionBy("id").orderBy("often", "gram")
    # A member that only one text has comes first and meets nobody; so many places of the prefix are gone.
    shared = each.join(often, "gram").withColumn("place", F.row_number().over(order))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    room = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    first = shared.withColumn("alone", alone).where(F.col("place") + F.col("alone") <= room).select("id", "n", "gram")
    first = stage(first, "prefixes")
    a, b = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "gram"), first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "gram")
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    return a.join(b, "gram").where(close).select("a", "b").distinct()


#: A class of more equal texts than this is given by representatives and membership.
COPIES = 1_000


def similar_rows(records: DataFrame, threshold: float = 0.5, size: int = 3, copies: int = COPIES, **how) -> DataFrame:
    """(row_id_a, row_id_b), a < b: rows of different source_id with likeness of body_text >= threshold.

    Likeness is the Jaccard similarity of the sets of runs of ``size`` words.
    A row counts once however often it is repeated; null texts, texts with
    fewer words, and rows with a null row_id or source_id take no part.

    All pairs are given, but for classes of more than ``copies`` rows of the
    same text, whose pairs would be quadratic: these take part by two
    representatives, the lowest rows of two sources (of its one source, if it
    has no second), and every other row of the class is paired with these.
    So no link between different texts is lost, nor a row that has one.
    """
    good = records.where(F.col("row_id").isNotNull() & F.col("source_id").isNotNull() & F.col("body_text").isNotNull())
    texts = good.select(digest("body_text").alias("id"), F.col("body_text").alias("text"))
    rows = good.where(_wordy("body_text", size)).select("row_id", "source_id", digest("body_text").alias("id")).distinct()
    rows = stage(rows, "rows")
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    near = similar_classes(texts, threshold, size, **how).select("a", "b")
    # A class of several rows also meets itself.
    both = near.unionByName(sizes.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b")))
    members, hot = rows, sizes.where(F.col("n") > copies).select("id")
    every = None
    if not hot.isEmpty():
        large = rows.join(hot, "id", "left_semi")
        # The window keeps two rows a class in each partition before it shuffles.
        sources = large.groupBy("id", "source_id").agg(F.min("row_id").alias("row_id"))
        heads = sources.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("row_id", "source_id"))).where("p <= 2")
        heads = stage(heads.select("row_id", "source_id", "id"), "heads")
        members = rows.join(hot, "id", "left_anti").unionByName(heads)
        every = large.select("id", F.col("row_id").alias("ra"), F.col("source_id").alias("sa"))
        every = every.join(heads.select("id", F.col("row_id").alias("rb"), F.col("source_id").alias("sb")), "id").where("sa <> sb and ra <> rb").select("ra", "rb")
    side = lambda c: members.select(F.col("id").alias(c), F.col("row_id").alias(f"r{c}"), F.col("source_id").alias(f"s{c}"))
    met = both.join(side("a"), "a").join(side("b"), "b").where("sa <> sb and ra <> rb and (a <> b or ra < rb)").select("ra", "rb")
    met = met if every is None else met.unionByName(every)
    return met.select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b")).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b", most: int = 50) -> DataFrame:
    """(id, component): connected components, named by their lowest id, by alternating large-star and small-star.

    Only ids that occur in a pair are returned.  Every round is cut with a
    checkpoint in the shared folder; rounds grow as the logarithm of the
    component size.  ``most`` rounds without convergence raise.
    """
    edges = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most):
        # Large-star: the larger neighbours of u go to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: u and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct())
        moved = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if moved == 0:
            break
    else:
        raise RuntimeError("components did not converge")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def groups(records: DataFrame, threshold: float = 0.5, size: int = 3, **how) -> DataFrame:
    """(row_id, group_id, links): every row with text, its group (the lowest row of it) and its class's links to other classes."""
    good = records.where(F.col("row_id").isNotNull() & F.col("body_text").isNotNull())
    texts = good.select(digest("body_text").alias("id"), F.col("body_text").alias("text"))
    near = stage(similar_classes(texts, threshold, size, **how), "near")
    comp = components(near)
    links = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    rows = good.select("row_id", digest("body_text").alias("id")).distinct()
    named = rows.join(comp, "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = named.groupBy("component").agg(F.min("row_id").alias("group_id"))
    return named.join(lowest, "component").select("row_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
