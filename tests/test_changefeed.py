"""The change feed against a sequential model, in any order and number of deliveries."""

import random

from quarry.operators import changefeed
from quarry.session import scratch

SCHEMA = (
    "op_seq long, namespace string, kind string, record_id string, old_id string, target_id string, source_id string, "
    "stable_key string, idempotency_key string, received_at long, bucket string, h1 string"
)


def model(rows):
    ops, first = {}, {}
    for r in rows:
        whole = r[2] in ("assert", "supersede") and r[3] and r[6] and r[7] or r[2] == "forget" and r[5]
        if r[0] is not None and r[1] is not None and whole:
            ops[r[1], r[0]] = r
    for (ns, seq), r in ops.items():
        if r[8] is not None:
            first[ns, r[8]] = min(first.get((ns, r[8]), seq), seq)
    live = {}
    for (ns, seq), r in sorted(ops.items(), key=lambda x: x[0][1]):
        if r[8] is not None and first[ns, r[8]] != seq:
            continue
        span = (ns, r[6], r[7])
        if r[2] == "forget":
            live = {k: v for k, v in live.items() if not (k[0] == ns and v == r[5])}
        elif r[2] == "assert" or live.get(span) == r[4] and r[4] is not None:
            live[span] = r[3]
    return {(*k, v) for k, v in live.items()}


def feed(seed, n=240):
    rng, rows = random.Random(seed), []
    for seq in range(1, n):
        ns, span = rng.choice("ab"), rng.choice("pqrs")
        kind = rng.choice(["assert", "supersede", "supersede", "supersede", "forget"])
        rec = lambda: f"r{rng.randrange(6)}"
        key = rng.choice([None, f"k{rng.randrange(150)}"])
        if kind == "forget":
            rows.append((seq, ns, kind, None, None, rec(), None, None, key, seq, "x", None))
        else:
            rows.append((seq, ns, kind, rec(), rec() if kind == "supersede" else None, None, "s", span, key, seq, "x", None))
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    # Empty and refused operations.
    rows += [(None, "a", "assert", "r1", None, None, "s", "p", None, 0, None, None), (900, None, "assert", "r1", None, None, "s", "p", None, 0, None, None)]
    rows += [(901, "a", "forget", None, None, None, None, None, None, 0, None, None), (902, "a", "merge", "r1", None, None, "s", "p", None, 0, None, None)]
    rows += [(903, "a", None, "r1", None, None, "s", "p", None, 0, None, None), (904, "a", "supersede", "r9", None, None, "s", "zz", None, 0, None, None)]
    return rows


def state(store):
    return {tuple(r) for r in store.live().drop("op_seq").collect()}


def test_whole_feed(spark):
    rows = feed(1)
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 4)
    store.apply(spark.createDataFrame(rows, SCHEMA))
    assert state(store) == model(rows)


def test_batches_in_any_order(spark):
    rows = feed(2)
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 4)
    for part in (rows[::3], rows[1::3], rows[2::3]):
        store.apply(spark.createDataFrame(part, SCHEMA))
    assert state(store) == model(rows)
    store.apply(spark.createDataFrame(rows[:20], SCHEMA))  # repeats change nothing
    assert state(store) == model(rows)


def test_hot_span_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "PIECE", 7)
    rows = feed(3)
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 4)
    store.apply(spark.createDataFrame(rows, SCHEMA))
    assert state(store) == model(rows)


def test_only_touched_buckets_are_rewritten(spark):
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 16)
    one = lambda seq, key, rec: (seq, "a", "assert", rec, None, None, "s", key, None, 0, None, None)
    store.apply(spark.createDataFrame([one(i, f"k{i}", f"r{i}") for i in range(40)], SCHEMA))
    before = store.manifest()
    touched = store.apply(spark.createDataFrame([one(99, "k3", "new")], SCHEMA))
    after = store.manifest()
    assert len(touched) == 1
    assert store.apply(spark.createDataFrame([one(99, "k3", "new")], SCHEMA)) == []  # a repeat touches nothing
    assert {b for b in after["ops"] if after["ops"][b] != before["ops"].get(b)} == {str(touched[0])}


def test_only_named_buckets_are_read(spark, monkeypatch):
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 16)
    rows = [(i, "a", "assert", f"r{i}", None, None, "s", f"k{i}", f"key{i}", 0, None, None) for i in range(60)]
    store.apply(spark.createDataFrame(rows, SCHEMA))
    opened = {}
    part = changefeed.BucketStore._part
    monkeypatch.setattr(changefeed.BucketStore, "_part", lambda self, m, p, only=None: (opened.setdefault(p, set()).update(only), part(self, m, p, only))[1])
    # One new write and the forget of another record.
    late = [(99, "a", "assert", "new", None, None, "s", "k3", "other", 0, None, None), (100, "a", "forget", None, None, "r7", None, None, None, 0, None, None)]
    touched = store.apply(spark.createDataFrame(late, SCHEMA))
    assert 1 <= len(touched) <= 2 and opened["ops"] <= set(touched)
    assert len(opened["keys"]) == 1 and len(opened["records"]) <= 2 and len(opened["forgets"]) <= 2
    monkeypatch.undo()
    assert state(store) == model(rows + late)


def test_late_keys_undo_what_took_place(spark):
    row = lambda seq, kind, rec, old, target, span, key: (seq, "a", kind, rec, old, target, "s" if span else None, span, key, 0, None, None)
    batches = [
        [row(5, "assert", "r1", None, None, "p", "x"), row(6, "forget", None, None, "r1", None, "y"), row(7, "assert", "r2", None, None, "q", None)],
        [row(2, "assert", "r9", None, None, "q", "y")],  # the forget was a retry of it
        [row(1, "forget", None, None, "r7", None, "x")],  # so was the first assert of this
        [row(9, "forget", None, None, "r3", None, None)],
        [row(8, "assert", "r3", None, None, "z", None), row(4, "supersede", "r4", "r9", None, "q", None)],  # older than the forget above
    ]
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 4)
    for n, batch in enumerate(batches):
        store.apply(spark.createDataFrame(batch, SCHEMA))
        assert state(store) == model([r for b in batches[: n + 1] for r in b])


def test_empty_feed(spark):
    store = changefeed.BucketStore(spark, scratch(spark, "t"), 4)
    store.apply(spark.createDataFrame([], SCHEMA))
    assert state(store) == set()
