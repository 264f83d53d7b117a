"""Finding texts that were cut at a length limit or in transfer.

No labels exist, so they are made: intact texts are cut at random places, some
with a mark of the cut or at a limit, and a logistic regression on hashed
features of the ending learns to tell the cut from the uncut.  Texts among
the presumed intact that the model takes for cut are left out of the next
fit.  Then every text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows the classifier is fitted on at most, those of lowest hash; characters of the ending it sees; bits of the feature space.
SAMPLE, TAIL, BITS = 8_000, 240, 18
#: A length is a limit of a source if it is this many times as frequent as its neighbours, this often there, and few texts are longer.
SPIKE, LEAST, LONGER = 8.0, 2, 0.2
#: Score from which a text counts as cut, and from which one presumed intact is left out of the fit.
CUT, DOUBT = 0.5, 0.5
# Marks that transfer leaves after a cut.
MARKS = ["…", "...", " [...]", " […]", " [continued]", " (continued)", " [truncated]", " (truncated)", "�", " ..."]

_TOKEN = re.compile(r"[^\W_]+(?:[-'’./][^\W_]+)*|[^\w\s]+")


def limits(documents: DataFrame) -> DataFrame:
    """(source, char_limit, byte_limit): the lengths at which an unusual number of a source's texts end."""
    out = None
    for name, length in (("char_limit", F.length("text")), ("byte_limit", F.octet_length("text"))):
        counts = documents.where("text is not null").select("source", length.cast("long").alias("n")).groupBy("source", "n").agg(F.count("*").alias("c"))
        # One row per source and distinct length; the window spans lengths, not texts.
        near = Window.partitionBy("source").orderBy("n").rangeBetween(-60, 60)
        beyond = Window.partitionBy("source").orderBy("n").rangeBetween(24, Window.unboundedFollowing)
        around = counts.withColumn("rest", F.sum("c").over(near) - F.col("c")).withColumn("longer", F.coalesce(F.sum("c").over(beyond), F.lit(0)))
        often = (F.col("c") >= LEAST) & (F.col("c") >= SPIKE * (F.col("rest") / 120 + 0.1)) & (F.col("longer") <= F.col("c") * LONGER)
        spikes = around.where(often)
        best = spikes.groupBy("source").agg(F.max(F.struct("c", "n")).alias("b")).select("source", F.col("b.n").alias(name))
        out = best if out is None else out.join(best, "source", "full")
    return out


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, source and what the classifier sees of a text: its tail, lengths, whether a code fence is open, its source's limits.

    Null, empty and blank texts have no ending.  The open fence is counted
    over the whole text.  Copies of a row, alike in all that is seen, count
    once.
    """
    good = documents.where(F.col("text").isNotNull() & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    seen = good.select("doc_id", "source", *_view(F.col("text"))).dropDuplicates()
    return _with_limits(seen, documents)


def _view(text) -> list:
    fences = F.size(F.split(text, r"(?m)^\s*```")) - 1
    return [
        F.substring(text, -TAIL, TAIL).alias("tail"),
        F.length(text).cast("long").alias("chars"),
        F.octet_length(text).cast("long").alias("bytes"),
        (F.pmod(fences, F.lit(2)) == 1).alias("open_fence"),
    ]


def _with_limits(seen: DataFrame, documents: DataFrame) -> DataFrame:
    return seen.join(limits(documents), "source", "left")


def _near(n: int, limit) -> str:
    if limit is None or limit != limit:
        return "none"
    d = int(limit) - n
    return "at" if d == 0 else "just" if 0 < d <= 8 else "over" if -16 <= d < 0 else "below" if d > 0 else "beyond"


def features(tail: str, chars: int, size: int, open_fence: bool, char_limit, byte_limit) -> list[str]:
    """Names of the features of one ending."""
    body = tail.rstrip()
    lines = [x for x in body.split("\n") if x.strip()] or [""]
    line = lines[-1]
    t = [x.lower() for x in _TOKEN.findall(line[-160:])] or [""]
    start = re.match(r"\s*(\S{0,3})", line)[1]
    kind = "bullet" if start[:1] in "-*" and not start.startswith("--") else "sign" if start.startswith("--") else "fence" if start.startswith("```") else "pipe" if start.startswith("|") else "number" if re.match(r"\d+[.)]", line.strip()) else "chat" if line.startswith("[") else "head" if start.startswith("#") else "text"
    last = body[-1:] or " "
    group = "w" if last.isalpha() else "d" if last.isdigit() else last
    before = body[-2:-1]
    near = _near(chars, char_limit), _near(size, byte_limit)
    at = "at" if "at" in near else "just" if "just" in near else "over" if "over" in near else "no"
    tokens = min(len(t), 12)
    shape = "".join("d" if c.isdigit() else "w" if c.isalpha() else c for c in body[-3:])
    prior = lines[-2][:1] if len(lines) > 1 else ""
    pipes = f"{line.count('|')}={lines[-2].count('|') if len(lines) > 1 else 0}" if kind == "pipe" else ""
    return [
        "bias", f"end={group}", f"end2={before if not before.isalnum() else 'w'}{group}", f"kind={kind}", f"kind,end={kind},{group}",
        f"shape={shape}", f"at={at}", f"at,end={at},{group}", f"fence={open_fence}", f"fence,kind={open_fence},{kind}", f"t1={t[-1]}", f"kind,t1={kind},{t[-1]}",
        f"t2={' '.join(t[-2:])}", f"t3={' '.join(t[-3:])}", f"kind,n={kind},{tokens}", f"kind,n,end={kind},{tokens},{group}",
        f"first={t[0]}", f"first,end={t[0]},{group}", f"len1={min(len(t[-1]), 12)},{kind}", f"space={tail[len(body):][:2]!r}", f"pipes={pipes}", f"prior,kind={prior},{kind}",
        f"mark={next((m.strip() for m in sorted(MARKS, key=len, reverse=True) if body.endswith(m.strip())), '')}",
        f"punct={group in '.!?。:;,|`' and group not in ('w', 'd')}", f"kind,first2={kind},{' '.join(t[:2])}",
    ]


def hashed(rows: Iterator[tuple]) -> np.ndarray:
    """Feature numbers, a row per ending."""
    mask = (1 << BITS) - 1
    memo: dict[str, int] = {}
    out = []
    for row in rows:
        own = []
        for f in features(*row):
            h = memo.get(f)
            if h is None:
                h = memo[f] = xxhash.xxh32_intdigest(f) & mask
            own.append(h)
        out.append(own)
    return np.array(out, dtype=np.int64)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Weights of a logistic regression by Adagrad, with a weak pull to zero."""
    w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 512):
            at = order[a : a + 512]
            e = _sigmoid(w[x[at]].sum(1)) - y[at]
            flat = x[at].ravel()
            d = np.bincount(flat, weights=np.repeat(e, x.shape[1]), minlength=0) / len(at)
            used = np.flatnonzero(d)
            step = d[used] + 1e-6 * w[used]
            g[used] += step * step
            w[used] -= 0.3 * step / np.sqrt(g[used])
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_SEEN = ["tail", "chars", "bytes", "open_fence", "char_limit", "byte_limit"]


def _made(sample: DataFrame, copies: int = 2) -> pd.DataFrame:
    """The sample's endings as they are, and of ``copies`` artificial cuts of each; bounded by the sample."""
    cuts = F.explode(F.sequence(F.lit(0), F.lit(copies)))
    turned = sample.withColumn("copy", cuts)
    h = F.xxhash64("doc_id", "copy", F.lit(17))
    share = F.pmod(h, F.lit(10_000)) / 10_000.0
    place = F.greatest(F.lit(20), F.floor(F.length("text") * (F.lit(0.15) + F.lit(0.84) * share))).cast("int")
    style = F.pmod(F.shiftright(h, 20), F.lit(100))
    marks = F.array(*[F.lit(m) for m in MARKS])
    mark = F.when(style < 20, F.element_at(marks, (F.pmod(F.shiftright(h, 32), F.lit(len(MARKS))) + 1).cast("int"))).otherwise(F.lit(""))
    # Half of the marked cuts fall between words.
    head = F.expr("substring(text, 1, place)")
    text = F.when(F.col("copy") == 0, F.col("text")).otherwise(F.concat(F.when(style < 10, F.regexp_replace(head, r"\s+\S*$", "")).otherwise(head), mark))
    made = turned.withColumn("place", place).withColumn("cut", text)
    kept = made.where((F.col("copy") == 0) | (F.col("place") < F.length("text") - 2))
    view = kept.select(
        "doc_id", "copy", "char_limit", "byte_limit", ((style >= 70) | (style < 10)).alias("limited"), F.when(style < 10, F.pmod(h, F.lit(7))).otherwise(0).alias("short"),
        F.expr("substring(text, place - 2, 3)").alias("around"), F.expr("substring(text, place + 1, 2)").alias("next"), *_view(F.col("cut")),
    )
    return view.toPandas()


def train(documents: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on at most ``sample`` rows; all zero if there is nothing to fit."""
    good = documents.where(F.col("text").isNotNull() & (F.length("text") >= 60))
    narrow = good.select("doc_id", F.xxhash64("doc_id", F.lit(29)).alias("h")).orderBy("h", "doc_id").limit(sample)
    picked = good.select("doc_id", "source", "text").join(narrow.select("doc_id"), "doc_id", "left_semi")
    seen = _made(_with_limits(picked, documents))
    if not len(seen):
        return np.zeros(1 << BITS)
    # A cut that falls on the end of a sentence or line leaves a whole text, and is no example of either kind.
    whole = seen["around"].str.contains(r"[.!?。|`]\s*$|\n$", regex=True) | (seen["next"].str.startswith("\n"))
    seen = seen[(seen["copy"] == 0) | ~whole].reset_index(drop=True)
    cut = (seen["copy"] > 0).to_numpy()
    # Some artificial cuts are taken to be at their source's limit.
    with_limit = cut & seen["limited"].to_numpy() & seen["char_limit"].notna().to_numpy()
    seen["chars"] = np.where(with_limit, seen["char_limit"].fillna(0) - seen["short"], seen["chars"]).astype("int64")
    x = hashed(seen[_SEEN].itertuples(index=False, name=None))
    # Intact are those that a model fitted on other documents does not take for cut.
    fold = seen["doc_id"].map(lambda d: xxhash.xxh32_intdigest(str(d)) % 3).to_numpy()
    keep = cut | ~seen["chars"].isin(seen["char_limit"]).to_numpy()
    for _ in range(2):
        score = np.zeros(len(seen))
        for f in range(3):
            w = fit(x[keep & (fold != f)], cut[keep & (fold != f)].astype(float), rounds=3)
            score[fold == f] = _sigmoid(w[x[fold == f]].sum(1))
        keep = cut | (score < DOUBT)
    return fit(x[keep], cut[keep].astype(float))


def scored(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, source, score) for every document with an ending."""
    shared = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS numbers
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = hashed(pdf[_SEEN].itertuples(index=False, name=None))
            score = _sigmoid(shared.value[x].sum(1).astype(float)) if len(pdf) else []
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": score})

    return endings(documents).select("doc_id", "source", *_SEEN).mapInPandas(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, score double")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score) of the documents that were cut."""
    return scored(documents, train(documents)).where(F.col("score") >= CUT)


def rates(documents: DataFrame) -> DataFrame:
    """Per source: documents with an ending, those that were cut, and their share."""
    s = scored(documents, train(documents))
    out = s.groupBy("source").agg(F.count("*").alias("documents"), F.sum((F.col("score") >= CUT).cast("long")).alias("truncated"))
    return out.withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))
