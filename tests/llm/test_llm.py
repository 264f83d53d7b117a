"""The training-data operators: brute force, round trips, held-out accuracy, and hard inputs."""

import os
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import fusing, mixing, near_duplicates, neighbours, scans, splitting, tokens, truncation
from quarry.llm.ranks import slotted_sum

needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files")


# 1: splitting

def check_pieces(text, limit, overlap):
    got = splitting.spans(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in got) == text
    for n, (start, own, end) in enumerate(got):
        assert len(text[start:end].encode("utf-8", "surrogatepass")) <= limit
        assert end > own or not text
        if n:
            assert got[n - 1][2] == own and start >= got[n - 1][1]
            assert text[start:own] == text[: got[n - 1][2]][start:]
    return got


@given(st.text(max_size=400), st.integers(16, 90), st.integers(0, 30))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_pieces_of_hard_texts():
    check_pieces("x" * 50_000, 1000, 100)
    check_pieces("é漢😀" * 3000, 512, 40)
    got = check_pieces("alpha beta gamma. " * 60 + "\n\n" + "sun moon star. " * 60, 1300, 0)
    assert got[0][2] == len("alpha beta gamma. " * 60 + "\n\n")  # the topic boundary
    words = "one two three four. " * 200
    got = check_pieces(words, 500, 60)
    assert all(60 <= own - start <= 63 for start, own, _ in got[1:])
    assert all(words[end - 1] == " " for _, _, end in got[:-1])


def test_depths_find_the_valley():
    d = splitting.depths([["a", "b"]] * 6 + [["x", "y"]] * 6)
    assert max(range(len(d)), key=d.__getitem__) == 5


def test_oversized_types_and_nulls(spark):
    s = spark.createDataFrame([(1, 1, ["r"], "a" * 30, "x"), (2, 9, None, "a" * 30, "x"), (3, 1, ["r"], None, "x"), (1, 1, ["r"], "a" * 30, "x"), (4, 1, ["r"], "é" * 11, "x")], "section_id long, input_id long, section_path array<string>, text string, max_bytes string")
    i = spark.createDataFrame([(1, "b" * 45, " TEXT/Plain; charset=x"), (1, "b" * 45, " TEXT/Plain; charset=x"), (2, "", None), (None, "c" * 90, None)], "input_id long, text string, content_type string")
    limits = spark.createDataFrame([("section", "text/plain", 20, 2), ("section", "*", 40, 0), ("input", "*", 44, 5)], "item_kind string, content_type string, max_bytes int, overlap_bytes int")
    got = {tuple(r) for r in splitting.oversized(s, i, limits).collect()}
    assert got == {("section", 1), ("section", 4), ("input", 1), ("input", None)}
    assert splitting.oversized(s.limit(0), i.limit(0), limits).count() == 0


# 2: one ranking

CANDIDATES = "plan_id string, plan_namespace string, op_kind string, pos int, record_id string, namespace string, score double, score_method string, n int"
POLICIES = "namespace string, fusion_weights map<string,double>"


def brute_flow(rows, weights, reach):
    best = defaultdict(dict)
    for plan, pns, op, _, rec, ns, score, *_ in rows:
        if ns == pns and score is not None and score == score:
            best[plan, op][rec] = max(score, best[plan, op].get(rec, -1e9))
    out = defaultdict(float)
    for plan in {p for p, _ in best}:
        everyone = {r for (p, _), d in best.items() if p == plan for r in d}
        for op in {o for p, o in best if p == plan}:
            d = best[plan, op]
            level = lambda r: d.get(r, -1e18)
            pct = {r: (sum(level(x) < level(r) for x in everyone) + sum(level(x) == level(r) for x in everyone) / 2) / len(everyone) for r in everyone}
            for a in everyone:
                f = sum(min(max(pct[a] - pct[b], 0) / reach, 1) - min(max(pct[b] - pct[a], 0) / reach, 1) for b in everyone)
                out[plan, a] += weights.get(op, 1.0) * f / max(len(everyone) - 1, 1)
    return out


def candidate_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for plan in ("p", "q", "r"):
        for op in rng.sample(["a", "b", "c"], rng.randrange(1, 4)):
            for pos in range(rng.randrange(1, 12)):
                rows.append((plan, "n", op, pos, f"x{rng.randrange(9)}", rng.choice(["n", "n", "n", "m"]), rng.choice([1.0, 2.0, 5.5, 1e9, None, float("nan")]), "m", 1))
    return rows + rows[:4] + [(None, "n", "a", 0, "x", "n", 1.0, "m", 1), ("p", "n", "a", 0, None, "n", 1.0, "m", 1)]


@pytest.mark.parametrize("group", [50_000, 1])
def test_net_flow_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(fusing, "GROUP", group)
    rows, weights = candidate_rows(), {"a": 2.0, "b": 0.5}
    c = spark.createDataFrame(rows, CANDIDATES)
    p = spark.createDataFrame([("n", weights)], POLICIES)
    got = {(r.plan_id, r.record_id): r.net_flow for r in fusing.flows(c, p).collect()}
    want = brute_flow([r for r in rows if r[0] and r[4]], weights, fusing.REACH)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_no_method_rules_by_size(spark):
    rows = [("p", "n", op, i, r, "n", s, "m", 1) for op, scores in (("a", {"big": 1e6, "good": 9e5, "x": 1.0}), ("b", {"good": 0.9, "x": 0.5, "big": 0.1}), ("c", {"good": 0.9, "x": 0.5, "big": 0.1})) for i, (r, s) in enumerate(scores.items())]
    c, p = spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([("n", None)], POLICIES)
    assert [r.record_id for r in fusing.winners(c, p).collect()] == ["good"]
    assert [r.record_id for r in fusing.ranking(c, p).orderBy("position").collect()][0] == "good"
    tie = spark.createDataFrame([("p", "n", "a", 0, r, "n", 1.0, "m", 1) for r in ("b", "a")], CANDIDATES)
    assert [r.record_id for r in fusing.winners(tie, p).collect()] == ["a"]
    assert fusing.winners(c.limit(0), p).count() == 0


def test_slotted_sum(spark):
    rows = [("g", i % 5, i, 1 + i % 3) for i in range(50)]
    df = spark.createDataFrame([(g, o // 10, o, v) for g, _, o, v in rows], "g string, slot int, o int, v int")
    got = {r.o: r.s for r in slotted_sum(df, ["g"], "slot", [df.o], "v", "s").collect()}
    assert got == {o: sum(1 + i % 3 for i in range(o + 1)) for o in range(50)}


# 3: near duplicates

def variants(seed=1, families=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for f in range(families):
        base = rng.sample(words, 60)
        for v in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            n += 1
            rows.append((n, f"s{rng.randrange(3)}", rng.choice([" ", ", "]).join(own)))
    rows += [(n + 1, "s1", None), (n + 2, "s1", ""), (n + 3, "s2", "two words"), (n + 4, "s0", "two words"), (n + 5, "s0", rows[0][2].upper()), (n + 6, "s9", rows[0][2]), (n + 7, None, rows[0][2])]
    return rows + rows[:3]


def brute_pairs(rows, threshold=0.5, size=3):
    own = {i: (s, set(zip(*(near_duplicates.words(t)[k:] for k in range(size))))) for i, s, t in rows if t and s}
    return {(a, b) for a, b in combinations(sorted(own), 2) if own[a][0] != own[b][0] and near_duplicates.jaccard(own[a][1], own[b][1]) >= threshold}


RECORDS = "row_id long, source_id string, body_text string"


@pytest.mark.parametrize("crowd", [256, 1])
def test_similar_rows_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_duplicates, "CROWD", crowd)
    rows = variants()
    got = {tuple(r) for r in near_duplicates.similar_rows(spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == brute_pairs(rows)


def test_hot_classes_are_linked_by_representatives(spark):
    # A (20 rows) and its variants B (one row, of the source of A's lowest row) and C (30 rows).
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "s1" if i % 2 else "s0", text) for i in range(20)] + [(50, "s0", text + " end")] + [(60 + i, f"s{i % 3}", text + " or more") for i in range(30)]
    got = {tuple(r) for r in near_duplicates.similar_rows(spark.createDataFrame(rows, RECORDS), copies=6).collect()}
    want = brute_pairs(rows)
    assert got <= want and len(got) < len(want)
    assert {i for pair in got for i in pair} == {r[0] for r in rows}
    kind = {i: t for i, _, t in rows}
    assert {frozenset((kind[a], kind[b])) for a, b in got} == {frozenset((kind[a], kind[b])) for a, b in want}


def test_crowds_are_joined_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CROWD", 3)
    rng = random.Random(9)
    shared = [f"t{i}" for i in range(40)]
    # All share a template, which alone doesn't make them alike; families of three do.
    rows = []
    for f in range(25):
        own = [f"f{f}x{i}" for i in range(45)]
        for v in range(3):
            own[rng.randrange(45)] = "other"
            rows.append((len(rows), f"s{v}", " ".join(shared + own)))
    rows += [(200 + i, f"s{i}", " ".join(shared)) for i in range(3)]
    assert {tuple(r) for r in near_duplicates.similar_rows(spark.createDataFrame(rows, RECORDS)).collect()} == brute_pairs(rows)


def test_a_shared_phrase_brings_no_crowd_to_the_join(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CROWD", 3)
    joined, join = [], near_duplicates._prefix_pairs
    monkeypatch.setattr(near_duplicates, "_prefix_pairs", lambda texts, *a: joined.append(texts.count()) or join(texts, *a))
    phrase = [f"t{i}" for i in range(22)]
    # Every tenth text has a variant; the others have no more than the phrase in common.
    rows = [(i, f"s{i % 3}", " ".join(phrase + [f"f{i - (i % 10 == 1)}x{j}" for j in range(38)])) for i in range(600)]
    assert {tuple(r) for r in near_duplicates.similar_rows(spark.createDataFrame(rows, RECORDS)).collect()} == brute_pairs(rows) != set()
    assert sum(joined) < 200


def test_texts_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BATCH", 5)
    rows = variants(6)
    df = spark.createDataFrame([*rows, *reversed(rows)], RECORDS).coalesce(2)
    assert {tuple(r) for r in near_duplicates.similar_rows(df).collect()} == brute_pairs(rows)


def test_large_classes_give_all_pairs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    # The variant shares its source with the lowest row of the large class.
    rows = [(0, "s1", text)] + [(i, "s2", text) for i in range(1, 70)] + [(90, "s1", text + " end")]
    rows += [(i, f"s{i % 3}", text + " end or more") for i in range(100, 180)]
    got = [tuple(r) for r in near_duplicates.similar_rows(spark.createDataFrame(rows, RECORDS)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_groups_and_components(spark):
    rows = variants(3)
    got = {r.row_id: r.group_id for r in near_duplicates.groups(spark.createDataFrame(rows, RECORDS).select("row_id", "body_text"), 0.5, 3).collect()}
    parent = {i: i for i, _, t in rows if t is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    loose = [(i, "s" + str(n), t) for n, (i, _, t) in enumerate({r[0]: r for r in rows}.values()) if t is not None]
    texts = {i: t for i, _, t in loose}
    equal = {(a, b) for a, b in combinations(sorted(texts), 2) if texts[a] == texts[b]}
    for a, b in brute_pairs(loose) | equal:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in parent}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    comp = {r.id: r.component for r in near_duplicates.components(chain).collect()}
    assert comp == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_similar_rows_of_nothing(spark):
    assert near_duplicates.similar_rows(spark.createDataFrame([], RECORDS)).count() == 0


# 4: most similar vectors

VECTORS = "row_id long, namespace string, producer_version string, embedding array<float>, id string"


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    x[400:450] = x[:50] + rng.normal(size=(50, 8)) * 0.1
    rows = [(i, "a" if i % 3 else None, "v", [float(v) for v in x[i]], "c") for i in range(900)]
    rows += [(2000, "a", "v", None, "c"), (2001, "a", "v", [0.0] * 8, "c"), (2002, "a", "v", [float("nan")] * 8, "c"), (2003, "a", "v", [1.0], "c"), *rows[:5]]
    df = spark.createDataFrame(rows, VECTORS)
    for how, least in (({"least": 5000}, 1.0), ({}, 0.95), ({"least": 40, "block": 150, "visits": 3, "queries": 50}, 0.85)):
        got = defaultdict(list)
        for r in neighbours.neighbours(df, 10, dim=8, **how).collect():
            got[r.id].append(r.other)
        hits = total = 0
        for part in ([i for i in range(900) if i % 3], [i for i in range(900) if not i % 3]):
            u = np.array([x[i] / np.linalg.norm(x[i]) for i in part])
            s = u @ u.T
            np.fill_diagonal(s, -9)
            for n, i in enumerate(part):
                want = {part[j] for j in np.argsort(-s[n])[:10]}
                hits, total = hits + len(want & set(got[i])), total + 10
        assert hits / total >= least
        assert all(len(v) == 10 and k not in v for k, v in got.items())


def test_pairs_ties_and_nothing(spark):
    same = spark.createDataFrame([(i, "a", "v", [1.0, 2.0], "c") for i in range(14)] + [(20, "b", "v", [1.0, 2.0], "c")], VECTORS)
    first = [r.other for r in neighbours.neighbours(same, 3, dim=2).where("id = 9").orderBy("position").collect()]
    assert first == [0, 1, 2]
    pairs = {tuple(r) for r in neighbours.similar_pairs(same, 0.85, 10, dim=2).collect()}
    assert pairs and all(a < b < 20 for a, b in pairs)
    assert neighbours.similar_pairs(same.limit(0), dim=2).count() == 0


def test_near_equal_vectors_beyond_a_block(spark):
    # One hot cell of several blocks, of which the nearest may stand anywhere; near cells are looked at as well.
    rng = np.random.default_rng(8)
    x = np.ones((5_000, 4)) + rng.normal(size=(5_000, 4)) * 0.001
    x[4_000:] = rng.normal(size=(1_000, 4))
    df = spark.createDataFrame([(i, "a", "v", [float(v) for v in x[i]], "c") for i in range(5_000)], VECTORS)
    for block, visits, share, least in ((20_000, 4, 1.0, 0.999), (20_000, 4, 0.35, 0.99), (1_000, 3, 0.35, 0.97)):
        got = defaultdict(list)
        for r in neighbours.neighbours(df, 10, dim=4, block=block, visits=visits, share=share).collect():
            got[r.id].append(r.other)
        assert all(len(set(got[i])) == 10 for i in range(5_000))
        u = x.astype(np.float32) / np.linalg.norm(x, axis=1)[:, None]
        hits = []
        for i in range(0, 5_000, 10):
            s = u @ u[i]
            s[i] = -9
            tenth = np.partition(s, -10)[-10]
            hits += [s[j] >= tenth - 2e-7 for j in got[i]]
        assert np.mean(hits) >= least


def test_recall_where_most_of_a_block_is_not_gathered(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 16))[rng.integers(60, size=3_000)] + rng.normal(size=(3_000, 16)) * 0.5).astype(np.float32)
    df = spark.createDataFrame([(i, "a", "v", [float(v) for v in x[i]], "c") for i in range(len(x))], VECTORS)
    got = {(r.id, r.other) for r in neighbours.neighbours(df, 10, dim=16).where("id < 200").collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(200) for j in np.argsort(-s[i])[:10]}
    assert len(got & want) >= 0.95 * len(want)


def test_equal_vectors_beyond_k(spark):
    # A hot vector: rows beyond the k + 1 lowest have the lowest as neighbours, and no block holds them all.
    rng = np.random.default_rng(6)
    rows = [(i, "a", "v", [1.0, 2.0, 3.0, 4.0], "c") for i in range(400)] + [(i, "a", "v", [float(v) for v in rng.normal(size=4)], "c") for i in range(400, 500)]
    got = defaultdict(list)
    for r in neighbours.neighbours(spark.createDataFrame(rows + rows[:9], VECTORS), 3, dim=4).orderBy("id", "position").collect():
        got[r.id].append(r.other)
    assert len(got) == 500 and all(len(v) == 3 for v in got.values())
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[3] == [0, 1, 2] and got[399] == [0, 1, 2]


def test_cells_come_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    got = list(neighbours.order_cells(a, b))
    sums = [a[i] + b[j] for i, j in got]
    assert len(set(got)) == 35 and all(x <= y + 1e-12 for x, y in zip(sums, sums[1:]))


# 5: scans

LEXICON = dict.fromkeys("the manager keeps training records of each tenant until they are rejected by onboarding and the reading room closes read-only line break".split(), 500)


def test_repair_of_a_scanned_page():
    reader = scans.Reader(LEXICON)
    text = "The m@nager keeps train-\ning records of each\n\n- 7 -\n\nfenant until they are rejected by on-\nboarding and the read-\nonly line."
    fixed = scans.repair(text, reader, {3})
    assert fixed == "The manager keeps training records of each tenant until they are rejected by onboarding and the read-only line."
    hyphen, chars, edge = scans.inspect(text, reader)
    assert hyphen and chars and (3, "", "-#-", 7) in [c[:4] for c in edge]


@pytest.mark.parametrize("text", ["", "The manager keeps\ntraining records.", "| a | 1 |\n|---|---|\n| b | 2 |", "12\n13\n14", "Items l07, O5x and rn53 are part codes.", "see read-\nonly line", "```\nm@nager\n```", "aGVsbG8" * 3000])
def test_clean_texts_stay(text):
    reader = scans.Reader(LEXICON)
    assert scans.repair(text, reader, set()) == text
    assert scans.inspect(text, reader)[:2] == (False, False)


def test_noise_by_section(spark):
    words = "the manager keeps training records of each tenant until rejected"
    rows = [(i, i // 4, f"{words}. {words}.") for i in range(60)]
    rows += [(100, 50, "the m@nager keeps records."), (101, 50, "the mana-\nger keeps"), (102, 50, "records of each\nChapter 1    Page 3 of 9\ntenant until"), (103, None, None), (104, None, ""), (100, 50, "the m@nager keeps records.")]
    df = spark.createDataFrame(rows, "section_id long, input_id long, text string")
    assert {tuple(r) for r in scans.noise(df).collect()} == {(100, "chars"), (101, "hyphen"), (102, "furniture")}
    fixed = {r.section_id: r.repaired for r in scans.repaired(df).collect()}
    assert fixed[100] == "the manager keeps records." and fixed[102] == "records of each tenant until" and fixed[103] is None and fixed[0] == rows[0][2]
    assert scans.noise(df.limit(0)).count() == 0


def test_furniture_repeats_or_counts_up(spark):
    body = "the manager keeps training records of each tenant until they are rejected by onboarding"
    page = lambda n, head: f"{body} and so\n\n{head}\n\n{n}\n\n{body}."
    rows = [(1, 1, page(4, "Records Manua1 2020")), (2, 1, page(5, "Records Manual 2020")), (3, 1, f"{body}.\n\nRecords Manual 2O20")]
    rows += [(10 + i, 9, f"{body}.\n\n{n}\n\n{body}.") for i, n in enumerate((70, 15, 3))]  # numbers, but no sequence
    rows += [(20 + i, 20 + i, f"{body}.\n\nBack to top\n\n{body}.\n\nBack to top") for i in range(12)]
    rows += [(40, None, f"{body}.\n\n7\n\n{body}."), (41, None, f"{body}.\n\n8\n\n{body}.")]
    df = spark.createDataFrame(rows, "section_id long, input_id long, text string")
    got = {r.section_id for r in scans.noise(df).where("noise = 'furniture'").collect()}
    assert got == {1, 2, 3, 40, 41}
    fixed = {r.section_id: r.repaired for r in scans.repaired(df).collect()}
    assert fixed[1] == f"{body} and so {body}." and fixed[20] == rows[6][2]


def test_misread_words_of_any_length_and_number():
    reader = scans.Reader({"internationalisation": 400, "modern": 400, "modem": 30, "the": 900})
    assert reader.reading("internat1onal1sat1on") == "internationalisation" and reader.reading("iiitemationa1isation") is None
    assert reader.reading("rnodern") == "modern" and reader.reading("modem") is None and reader.reading("Mode rn".replace(" ", "")) is None
    assert reader.reading("clocl") is None


def test_inputs_are_repaired_as_well(spark):
    words = "the manager keeps training records of each tenant until rejected"
    s = spark.createDataFrame([(i, i, f"{words}. {words}.") for i in range(60)] + [(100, 50, "the m@nager keeps records.")], "section_id long, input_id long, text string")
    rows = [(i, f"# {words}\n\n{words}. {words}.") for i in range(60)] + [(70, "the m@nager keeps\nthe mana-\nger keeps"), (71, None), (70, "the m@nager keeps\nthe mana-\nger keeps")]
    got = scans.repaired_items(s, spark.createDataFrame(rows, "input_id long, text string")).collect()
    fixed = {(r.item_kind, r.item_id): r.repaired for r in got}
    assert len(got) == len(fixed) == 61 + 62
    assert fixed["section", 100] == "the manager keeps records."
    assert "m@nager" not in fixed["input", 70] and "mana-" not in fixed["input", 70]
    assert fixed["input", 71] is None and fixed["input", 0] == rows[0][1]


# 8: tokens

@needs_ranks
@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_round_trip_and_safe_cuts(text):
    ids = tokens.encode_text(text)
    assert tokens.decode_ids(ids) == text.encode("utf-8", "surrogatepass") or any(0xD800 <= ord(c) < 0xE000 for c in text)
    parts = tokens.pieces(text, 20)
    assert "".join(parts) == text
    assert [i for p in parts for i in tokens.encode_text(p)] == ids


@needs_ranks
def test_encode_table(spark):
    special, long = "<|endoftext|> x", "word and 漢字 " * 20_000
    rows = [(1, None), (2, ""), (3, " "), (4, special), (5, long), (6, "x" * 30_000), (4, special)]
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 7
    by = dict(got)
    assert by[1] == by[2] == [] and tokens.decode_ids(by[4]).decode() == special and len(by[4]) > 3
    assert by[5] == tokens.encoder().encode_ordinary(long) and tokens.decode_ids(by[6]) == b"x" * 30_000
    counted = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert counted == {k: len(v) for k, v in by.items()}
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@needs_ranks
def test_pattern_is_the_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    assert tokens.PATTERN == P.PATTERN


# 9: mixing

TARGETS = "source string, target_share double, max_repeats int"
SIZES = "doc_id long, source string, n_tokens long"


def test_mix_meets_shares(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["big", "big", "big", "mid", "small", "other"]), rng.randrange(20, 200)) for i in range(3000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 4)], TARGETS)
    mix = mixing.schedule(spark.createDataFrame(rows, SIZES), targets)
    share = {r.source: r for r in mixing.shares(mix, targets).collect()}
    assert share["absent"].tokens == 0
    present = sum(share[s].tokens for s in ("big", "mid", "small"))
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(share[s].tokens / present - t / 0.95) < 0.01
        assert share[s].most_repeats <= {"big": 1, "mid": 2, "small": 3}[s]


def test_mix_budget_and_edges(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("c", None, 1), ("d", 0.1, 0)], TARGETS)
    rows = [(1, "a", 10), (2, "a", 0), (3, "b", 1000), (4, None, 5), (5, "c", 5), (6, "d", 5)]
    sizes = spark.createDataFrame(rows, SIZES)
    assert {(r.doc_id, r.pass_no) for r in mixing.schedule(sizes, targets, budget=10_000).collect()} == {(1, 1), (1, 2), (3, 1)}
    assert sum(r.n_tokens for r in mixing.schedule(sizes, targets, budget=25).collect()) == 20
    assert mixing.schedule(sizes.limit(0), targets).count() == 0
    assert {r.actual_share for r in mixing.shares(mixing.schedule(sizes.limit(0), targets), targets).collect()} == {0.0}


# 10: truncation

def sentences(rng):
    noun = lambda: rng.choice(["ledger", "queue", "manifest", "archive", "register"])
    return " ".join(f"The {noun()} was {rng.choice(['checked', 'moved', 'signed'])} before the {noun()} closed." for _ in range(rng.randrange(4, 15)))


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(1500):
        text = sentences(rng)
        if rng.random() < 0.2:
            text += "\n\n- " + "\n- ".join(rng.choice(["old", "new", "late"]) + " " + rng.choice(["ledger", "queue"]) for _ in range(3))
        if i % 12 == 0:
            text = text[: rng.randrange(len(text) // 2, len(text) - 8)].rstrip(" .\n")
            text += rng.choice(["", "", "", "…", " [...]"])
            cut.add(i)
        rows.append((i, text, f"s{i % 3}"))
    rows += [(9001, None, "s1"), (9002, "", "s1"), (9003, "  \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    assert len(got & cut) / len(cut) > 0.85 and len(got - cut) / max(1, len(got)) < 0.15
    assert truncation.truncated(df.limit(0)).count() == 0
