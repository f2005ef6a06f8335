"""Each operator on odd rows, against brute force, and on planted cases."""

import collections
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrytext.llm import base, components, decontamination, html_text, licenses, packing, passages, quality_rules, simhash, token_counts, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "a b c d e"), (5, "a b c d e"), (None, "x y z w v"), (6, "é " * 30_000)]
# Names that the operators use themselves.
CLASH = ["fp", "fingerprint", "component_id", "n_words", "row", "words", "w", "n", "s", "h", "doc", "ref", "kept", "kept_row", "host", "path", "rule", "verdict", "n_tokens", "bucket", "label", "good", "llr", "lines"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(4000)]


def prose(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# 1


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(2)
    for _ in range(400):
        h = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        k, lengths = rng.randint(1, 6), sorted(h)
        cost = lambda ends: sum(next(e for e in ends if e >= x) * c for x, c in h.items())
        best = min(cost([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        ends = packing.optimal_boundaries(h, k)
        assert len(ends) <= k and cost(ends) == best
    assert packing.optimal_boundaries({}) == []


def test_packing(spark, odd, none):
    rows = packing.pack(odd, budget=10, max_length=100).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(False, 1, 0), (False, 2, 0), (False, 3, 0), (False, 4, 1), (False, 5, 5), (False, 5, 5), (False, 6, 30000), (True, 0, 5)]
    assert len({(r["bucket"], r["batch_id"], r["slot"]) for r in rows}) == len(rows)
    for key, group in collections.Counter((r["bucket"], r["batch_id"], r["bucket_length"]) for r in rows if 0 <= r["bucket"] < 16).items():
        assert group == 1 or group * key[2] <= 10
    assert packing.pack(none).count() == 0


# 2


def test_passages_are_found(spark, vocabulary):
    rng = random.Random(5)
    texts = [prose(rng, vocabulary, 400) for _ in range(30)]
    shared = prose(rng, vocabulary, 60)
    fuzzy = [w if k % 12 else "changed" for k, w in enumerate(prose(rng, vocabulary, 120))]
    plain = list(fuzzy)
    for k in range(5, 120, 13):
        plain[k] = "other"
    texts[3][50:50], texts[17][200:200], texts[22][:0] = shared, shared, shared
    texts[8][100:100], texts[9][30:30] = fuzzy, plain
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    found = passages.find_passages(docs_of(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == {17, 22, 9}
    assert all(r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8 for r in found)
    cut = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs_of(spark, rows)).collect()}
    assert len(cut) == 30 and " ".join(shared) in cut[3] and " ".join(shared) not in cut[17] and cut[5] == rows[5][1]


def test_passages_of_odd_rows(spark, odd, none):
    assert {r["doc_id"] for r in passages.find_passages(odd).collect()} == set()
    assert passages.find_passages(none).count() == 0
    kept = passages.remove_passages(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and passages.remove_passages(none).count() == 0


def test_chains_are_best():
    rng = random.Random(9)
    for _ in range(60):
        points = sorted({(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(12)})
        x, y = [p[0] for p in points], [p[1] for p in points]
        best = [0.0] * len(points)
        for i in range(len(points)):
            best[i] = 5 + max([0.0] + [best[j] - 0.25 * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]])
        first = passages.chains(x, y)[0]
        score = 5 * len(first) - 0.25 * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(first, first[1:]))
        assert abs(score - max(best)) < 1e-9
        assert sorted(i for c in passages.chains(x, y) for i in c) == list(range(len(points)))


def test_shared_runs_share_seeds(vocabulary):
    rng = random.Random(1)
    run = prose(rng, vocabulary, passages.K + passages.WINDOW - 1)
    one, two = ([w.encode() for w in prose(rng, vocabulary, 40) + run + prose(rng, vocabulary, 40)] for _ in range(2))
    assert set(passages.seeds(passages.word_hashes(one))[1].tolist()) & set(passages.seeds(passages.word_hashes(two))[1].tolist())


def test_similar_part_of_a_loose_alignment(spark, vocabulary):
    rng = random.Random(21)
    equal, loose = prose(rng, vocabulary, 60), prose(rng, vocabulary, 203)
    other = [w if k % 7 < 4 else f"x{k}" for k, w in enumerate(loose)]
    texts = [prose(rng, vocabulary, 90) + equal + loose, prose(rng, vocabulary, 70) + equal + other]
    found = passages.find_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert any(r["start_word"] <= 70 and r["end_word"] >= 130 for r in found)
    assert all(r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8 for r in found)


def test_short_fuzzy_passages(spark, vocabulary):
    rng = random.Random(23)
    texts, planted = [], 0
    for rate in (0.1, 0.15, 0.18):
        for _ in range(20):
            one = prose(rng, vocabulary, 60)
            two = list(one)
            for k in rng.sample(range(3, 57), round(60 * rate)):
                two[k] = f"y{rng.random()}"
            texts += [prose(rng, vocabulary, 80) + w + prose(rng, vocabulary, 80) for w in (one, two)]
            planted += 1
    found = passages.find_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    hit = {(r["ref_doc_id"], r["doc_id"]) for r in found}
    assert all(r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8 for r in found)
    assert all(a % 2 == 0 and b == a + 1 for a, b in hit) and len(hit) >= 0.95 * planted, len(hit)


def test_passages_that_an_earlier_document_holds_in_part(spark, vocabulary):
    rng = random.Random(29)
    texts, planted = [], set()
    own = lambda words, n=80: prose(rng, vocabulary, n) + words + prose(rng, vocabulary, n)
    for _ in range(12):  # an earlier document holds 49 of 54 words
        run = prose(rng, vocabulary, 54)
        texts += [own(run[:49]), own(run), own(run)]
        planted.add((len(texts) - 2, len(texts) - 1))
    for _ in range(12):  # two earlier documents hold a half each
        run = prose(rng, vocabulary, 60)
        texts += [own(run[:30]), own(run[30:]), own(run), own(run)]
        planted.add((len(texts) - 2, len(texts) - 1))
    half = prose(rng, vocabulary, 40)  # a line that all share is no passage
    texts += [own(half) for _ in range(8)]
    # The holder has the first half twice, and the run at the second place.
    run = prose(rng, vocabulary, 56)
    texts += [own(run[:40] + prose(rng, vocabulary, 30) + run), own(run[:40]), own(run)]
    planted.add((len(texts) - 3, len(texts) - 1))
    found = passages.find_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert {(r["ref_doc_id"], r["doc_id"]) for r in found} == planted


def test_slices_change_no_passage(spark, vocabulary, monkeypatch):
    rng = random.Random(31)
    texts = [prose(rng, vocabulary, 500) for _ in range(8)]
    for k in range(1, 8):
        n = 40 * k
        texts[k][200 : 200 + n] = [w if q % 6 else f"z{k}" for q, w in enumerate(texts[0][100 : 100 + n])]
    docs = docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    whole = {tuple(r) for r in passages.find_passages(docs).collect()}
    monkeypatch.setattr(passages, "SLICE", 60)
    assert whole and {tuple(r) for r in passages.find_passages(docs).collect()} == whole


def test_pairs_passed_over_have_no_similar_part():
    rng = np.random.default_rng(3)
    passed = 0
    for _ in range(700):
        a = rng.integers(0, 400, 150).astype(np.uint16)
        b = rng.integers(0, 400, 150).astype(np.uint16)
        size, at, to = int(rng.integers(20, 110)), int(rng.integers(0, 40)), int(rng.integers(0, 40))
        b[to : to + size] = np.where(rng.random(size) < rng.uniform(0.6, 1.0), a[at : at + size], b[to : to + size])
        runs = passages.align(a, b, at, to)[0]
        if not passages.may_match(a, b, 50, 0.8):
            passed += 1
            assert not passages.similar_parts(runs, 50, 0.8)
        # The parts found are as long as any: against all pairs of runs.
        wide = max((x2 + n2 - x1 for i, (x1, y1, _) in enumerate(runs) for j, (x2, y2, n2) in enumerate(runs[i:], i) if min(x2 + n2 - x1, y2 + n2 - y1) >= 50 and sum(r[2] for r in runs[i : j + 1]) >= 0.8 * max(x2 + n2 - x1, y2 + n2 - y1)), default=None)
        found = passages.similar_parts(runs, 50, 0.8)
        assert (found[0][1] - found[0][0] if found else None) == wide
    assert passed > 50


def covers(found, doc, words, run):
    """Whether the passages of ``doc`` cover most words of the run that it holds."""
    at = next(k for k in range(len(words)) if words[k : k + len(run)] == run)
    hit = {w for r in found if r["doc_id"] == doc for w in range(r["start_word"], r["end_word"])}
    return len(hit & set(range(at, at + len(run)))) >= 0.8 * len(run)


@pytest.mark.parametrize("size,step", [(14, 9), (20, 12), (30, 17)])
def test_passage_that_earlier_documents_quote_in_pieces(spark, vocabulary, size, step):
    rng = random.Random(size)
    run = prose(rng, vocabulary, 120)
    fuzzy = [w if k % 9 else f"q{k}" for k, w in enumerate(run)]
    own = lambda words: prose(rng, vocabulary, 60) + words + prose(rng, vocabulary, 60)
    texts = {k: own(run[at : at + size]) for k, at in enumerate([*range(0, 120, step), *range(5, 100, step)])}
    texts |= {1000: own(run), 1001: own(run), 1002: own(fuzzy)}
    docs = docs_of(spark, [(k, " ".join(t)) for k, t in texts.items()])
    rows = [sorted(map(tuple, passages.find_passages(docs.repartition(n)).collect())) for n in (1, 7)]
    assert rows[0] == rows[1]
    found = passages.find_passages(docs.repartition(40)).collect()
    assert sorted(map(tuple, found)) == rows[0]
    assert covers(found, 1001, texts[1001], run) and covers(found, 1002, texts[1002], fuzzy) and {r["doc_id"] for r in found} == {1001, 1002}


def test_fuzzy_passages_that_many_earlier_documents_quote(spark, vocabulary):
    rng = random.Random(47)
    texts, planted = [], set()
    own = lambda words, n=80: prose(rng, vocabulary, n) + words + prose(rng, vocabulary, n)
    for holders in (4, 9):  # more earlier holders of every piece than any number of rounds tried
        run = prose(rng, vocabulary, 90)
        texts += [own(run[at : at + 16]) for at in range(0, 90, 8) for _ in range(holders)]
        for kind in "wxyz":
            texts.append(own([w if k % 9 else f"{kind}{k}" for k, w in enumerate(run)]))
        planted |= {(a, b) for b in range(len(texts) - 4, len(texts)) for a in range(len(texts) - 4, b)}
    found = passages.find_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert {(r["ref_doc_id"], r["doc_id"]) for r in found} == planted


def test_links_are_not_lost_to_an_earlier_similar_document(spark, vocabulary):
    rng = random.Random(53)
    run = prose(rng, vocabulary, 80)
    changed = lambda rest: [w if k % 10 not in rest else f"c{k}x{len(rest)}" for k, w in enumerate(run)]
    # Each side is similar to the middle, the sides are not similar to each other.
    one, two, middle = changed((0,)), changed((8, 9)), list(run)
    texts = [prose(rng, vocabulary, 70) + w + prose(rng, vocabulary, 70) for w in (one, two, middle)]
    found = passages.find_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert {(r["ref_doc_id"], r["doc_id"]) for r in found} == {(0, 2), (1, 2)}


def test_passages_with_few_seeds_are_cut(spark, vocabulary):
    rng = random.Random(59)
    texts, planted = [], []
    own = lambda words, n=60: prose(rng, vocabulary, n) + words + prose(rng, vocabulary, n)
    for _ in range(12):
        run = prose(rng, vocabulary, 60)
        # Equal words four by four but for twelve of them: one or two seeds, which an earlier document has too.
        fuzzy = [w if k % 5 != 4 or 24 <= k < 36 else f"s{rng.random()}" for k, w in enumerate(run)]
        texts += [own(run[20:40]), own(run), own(fuzzy)]
        planted.append(len(texts) - 1)
    cut = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()}
    assert [k for k, t in enumerate(texts) if len(cut[k].split()) < len(t) - 45] == planted
    assert all(cut[k] == " ".join(t) for k, t in enumerate(texts) if k not in planted)


def test_passages_keep_what_their_result_reads_only(spark, vocabulary):
    rng = random.Random(67)
    run = prose(rng, vocabulary, 60)
    docs = docs_of(spark, [(k, " ".join(prose(rng, vocabulary, 70) + run)) for k in range(3)])
    folder = lambda: {p.name.split("-")[0] + p.name[-32:] for p in Path(base._folder(spark).removeprefix("file://")).glob("*")}
    before = folder()
    found = passages.find_passages(docs)
    assert sorted(n[:-32] for n in folder() - before) == ["passages"] * 3
    assert {(r["ref_doc_id"], r["doc_id"]) for r in found.collect()} == {(0, 1), (0, 2)}
    before = folder()
    cut = passages.remove_passages(docs)
    assert [n[:-32] for n in folder() - before] == ["spans"]
    assert sorted(len(r["text"].split()) for r in cut.collect()) == [70, 70, 130]


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {n for n in map(str, spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "shuffle_" in n}
    before = files()
    table = base.written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(r["count"] for r in table.collect()) == [142] * 1 + [143] * 6
    assert spark.conf.get(base._CLEANUP) == "false"


def test_passages_beyond_words_that_equal_an_earlier_text(spark, vocabulary):
    rng = random.Random(61)
    texts, planted = [], set()
    own = lambda words: prose(rng, vocabulary, 60) + words + prose(rng, vocabulary, 60)
    for _ in range(16):
        first, then = prose(rng, vocabulary, 60), prose(rng, vocabulary, 80)
        # The later two share all their seeds in words that equal the first text's, which shares too few with the last.
        texts += [own(first), own(first + then), own(first[30:] + [w if k % 5 != 4 else f"s{rng.random()}" for k, w in enumerate(then)])]
        planted |= {(len(texts) - 3, len(texts) - 2), (len(texts) - 2, len(texts) - 1)}
    docs = docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])
    assert {(r["ref_doc_id"], r["doc_id"]) for r in passages.find_passages(docs).collect()} == planted
    cut = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs).collect()}
    assert [k for k, t in enumerate(texts) if len(cut[k].split()) < len(t) - 45] == [k for k in range(len(texts)) if k % 3]


def test_pairs_that_are_not_compared_have_no_passage():
    rng = np.random.default_rng(7)
    kept = passed = 0
    for turn in range(60):
        seed, rows = rng.integers(0, 3000, 5), []
        base = rng.integers(0, 3000, 400)
        base[200:205] = seed
        for _ in range(12):  # fuzzy copies of a part around the seed, words left out and put in
            words, size = rng.integers(0, 3000, 400), [int(n) for n in rng.integers(0, 70, 2)]
            part = base[200 - size[0] : 205 + size[1]]
            part = np.where((rng.random(len(part)) < rng.uniform(0.6, 1.0)) | (np.abs(np.arange(len(part)) - size[0] - 2) < 3), part, rng.integers(0, 3000, len(part)))
            at = 200
            words[at - size[0] : at - size[0] + len(part)] = part
            if size[1] > 20 and turn % 2:
                words = np.delete(words, at + 5 + int(rng.integers(0, 20)))
            rows.append(words.astype("<u2"))
        i, j = passages.promising(np.zeros(12, np.int64), [w[:200].tobytes() for w in rows], [w[200:].tobytes() for w in rows], 50, 0.8, 5)
        pairs = set(zip(i.tolist(), j.tolist()))
        for a in range(12):
            for b in range(a + 1, 12):
                runs = passages.align(rows[a], rows[b], 200, 200)[0]
                through = [p for p in passages.similar_parts(runs, 50, 0.8) if p[0] <= 200 and 205 <= p[1]]
                kept += bool(through)
                passed += (a, b) not in pairs
                assert not through or (a, b) in pairs
    assert kept > 100 and passed > 100


def _three_words_again(before, after, marks, known, every_link):
    """By definition: whether the later of two rows has three words that the earlier has too, near enough behind the
    first difference, on either side of a seed."""
    reach, found = 50 + passages.REACH + 3 + 5, False
    for a, b, flags in ((before[0][::-1][:reach], before[1][::-1][:reach], [m[::-1] for m in marks[0]]), (after[0][:reach], after[1][:reach], marks[1])):
        run = next((t for t in range(max(len(a), len(b))) if a[t : t + 1] != b[t : t + 1]), None)
        flags = [[(f[t] if t < len(f) else 0) | 3 * whole for t in range(len(w))] for f, w, whole in zip(flags, (a, b), known)]
        if run is None:
            continue
        end = min(run + passages.REACH + 3, reach)
        beside = any(not f & 1 for f in flags[0][run:end]) or any(not f & 2 for f in flags[1][run:end])
        beside |= every_link and not all(known)
        places = collections.defaultdict(list)
        for o in range(len(b) - 2):
            places[tuple(b[o : o + 3])].append(o)
        for o in range(len(a) - 2):
            for other in places[tuple(a[o : o + 3])]:
                counts = any(f & 1 for f in flags[0][o : o + 3]) and any(f & 2 for f in flags[1][other : other + 3])
                close = max(o, other) - run <= (passages.REACH if o == other else passages.DROP)
                found |= counts and min(o, other) >= run and abs(o - other) <= passages.REACH and (close or beside)
    return found


@pytest.mark.parametrize("words", [3, 8, 60])
def test_pairs_to_compare_are_those_of_the_definition(words):
    rng, met, passed = np.random.default_rng(words), 0, 0
    for turn in range(40):
        base_, before, after, whole = rng.integers(0, words, 150), [], [], rng.random(10) < (1 if turn % 4 == 0 else 0.5)
        for _ in range(10):
            text = np.where(rng.random(150) < rng.choice([0.02, 0.1, 0.4]), rng.integers(0, words, 150), base_)
            at = int(rng.integers(80, 150)) if turn % 2 else 75 + int(rng.integers(0, 30))
            text = np.delete(text, at) if rng.random() < 0.5 else text
            text[75:80] = base_[75:80]
            before.append(text[int(rng.integers(0, 70)) : 75].astype("<u2"))
            after.append(text[75 : int(rng.integers(90, 148))].astype("<u2"))
        marks = [[rng.choice(np.array([0, 0, 0, 1, 2, 3], np.uint8), len(w)) for w in side] for side in (before, after)]
        every_link = bool(turn % 3)
        if every_link:
            marks = [[np.where(m > 0, 3, 0).astype(np.uint8) for m in side] for side in marks]
        given = (whole, whole, *([m.tobytes() for m in side] for side in marks), not every_link)
        i, j = passages.promising(np.zeros(10, np.int64), [w.tobytes() for w in before], [w.tobytes() for w in after], 50, 1.0, 5, given)
        pairs = set(zip(i.tolist(), j.tolist()))
        for a in range(10):
            for b in range(a + 1, 10):
                sides = [[w[k].tolist() for k in (a, b)] for w in (before, after)]
                want = _three_words_again(*sides, [[m[k].tolist() for k in (a, b)] for m in marks], [bool(whole[a]), bool(whole[b])], every_link)
                alike = sum(x == y for side, back in zip(sides, (-1, 1)) for x, y in zip(*(w[::back] for w in side)))
                assert not want or (a, b) in pairs
                assert want or (a, b) not in pairs or alike >= 50  # words in the same places are the other reason
                met, passed = met + want, passed + ((a, b) not in pairs)
    assert met > 500 and passed > 20


def test_near_copies_meet_a_few_times_for_each_seed(monkeypatch):
    rng = np.random.default_rng(9)
    base_, looked = rng.integers(0, 60_000, 200), []
    rows = [np.where(rng.random(200) < 0.06, rng.integers(0, 60_000, 200), base_) for _ in range(80)]
    for row in rows:
        row[100:105] = base_[100:105]
    for name in ("_apart", "_across"):
        if hasattr(passages, name):
            monkeypatch.setattr(passages, name, lambda *a, f=getattr(passages, name): ((looked.append(len(p)), (p, q))[1] for p, q in f(*a)))
    i, j = passages.promising(np.zeros(80, np.int64), [r[:100].astype("<u2").tobytes() for r in rows], [r[100:].astype("<u2").tobytes() for r in rows], 50, 0.8, 5)
    assert len(i) > 3000 and sum(looked) < 20 * len(i)


def test_equal_runs_against_brute_force(spark, vocabulary):
    rng = random.Random(41)
    lines = [prose(rng, vocabulary, rng.choice([8, 15, 30, 45, 55, 70])) for _ in range(14)]
    texts = [[w for _ in range(rng.randint(3, 7)) for w in (rng.choice(lines) if rng.random() < 0.6 else prose(rng, vocabulary, rng.randint(5, 60)))] for _ in range(60)]
    seen, wanted = {}, []
    for doc, words in enumerate(texts):
        own = {tuple(words[at : at + 50]) for at in range(len(words) - 49)}
        wanted += [(doc, at) for at in range(len(words) - 49) if tuple(words[at : at + 50]) in seen]
        for window in own:
            seen.setdefault(window, doc)
    found = passages.find_passages(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    hit = collections.defaultdict(set)
    for r in found:
        hit[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["ref_doc_id"]][r["ref_start_word"] : r["ref_end_word"]]
        assert r["ref_doc_id"] < r["doc_id"] and min(len(a), len(b)) >= 50 and r["identity"] >= 0.8
    missed = {(doc, w) for doc, at in wanted for w in range(at, at + 50) if w not in hit[doc]}
    assert len(wanted) > 500 and not any(len({w for d, w in missed if d == doc}) >= 50 for doc, _ in wanted)
    # Nothing is reported of documents that share less than 50 words with all others, by far.
    assert set(hit) <= {doc for doc, _ in wanted} | {r["doc_id"] for r in found if r["identity"] < 1}


def test_passages_of_rows_that_share_an_id(spark, vocabulary):
    rng = random.Random(43)
    shared, one, two = (prose(rng, vocabulary, n) for n in (70, 200, 200))
    rows = [(1, " ".join(prose(rng, vocabulary, 90) + shared)), (2, " ".join(one + shared)), (2, " ".join(two)), (2, " ".join(two)), (3, None)]
    docs = docs_of(spark, rows)
    assert {(r["doc_id"], r["ref_doc_id"]) for r in passages.find_passages(docs).collect()} == {(2, 1)}
    cut = collections.Counter((r["doc_id"], r["text"]) for r in passages.remove_passages(docs).collect())
    assert cut == collections.Counter([rows[0], (2, " ".join(one) + " "), rows[2], rows[3], rows[4]]) or cut == collections.Counter([rows[0], (2, " ".join(one)), rows[2], rows[3], rows[4]])
    named = docs.withColumn("doc_id", F.when(F.col("doc_id") == 3, "name").otherwise(F.col("doc_id").cast("string")))
    assert passages.remove_passages(named).count() == len(rows)


# 3


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/1?x", "https://www.example.com/en/#a", "http://a.b.example.com/en/", "http://example.com", "http://x.net/es/?q", "http://net/fr/a", "http://badexample.com/en/", "nothing", None, "http://example.org/en/", "x://y://example.com/en/", "", "http://www.example.com/eng"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)] + [(None, urls[0], "h", "r")], "page_id bigint, url string, host string, rule string")

    def judged(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")
        return host, path, rule, verdict

    rows = url_filter.judge(pages, url_filter.RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(urls[r["page_id"] or 0])
    assert url_filter.judge(pages.filter("false"), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], default="block").collect()} == {"block"}
    both = [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block")]
    assert url_filter.judge(pages.filter("page_id = 0"), spark.createDataFrame(both, "host string, path string, verdict string")).first()["verdict"] == "block"


# 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make this long enough to count as text.</p></div>
<div id="wrap"><div id="sidebar"><p>Side text that goes on for a while without any link at all.</p></div>
<article><h1>Title &amp; more</h1><p>First  paragraph\n with <a href="x">a link</a> &lt;and&gt; text that is long enough.<p><b>Second<br>paragraph</b> of the article, also with some words.
<div class="ad">Buy!</div><ul><li>point<li>other</ul></article>
<div class="comments"><p>A reader writes a very long comment here, longer than the article is, so that it would be dense.</p></div></div>
<form><label>Name</label><input></form><footer>&copy; foot</footer><script>var t="</p>";</script></body></html>"""


def test_html(spark):
    expected = "\n\n".join(["Title & more", "First paragraph with a link <and> text that is long enough.", "Second paragraph of the article, also with some words.", "point", "other"])
    assert html_text.main_text(PAGE) == expected
    pages = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>a &amp; b"), (5, "x", "<div>" * 5000 + "deep" + "</div>" * 4000), (6, "y", "plain < text"), (1, "u", PAGE), (7, "z", "<p>" + "long " * 100_000), (8, "q", "<a href=\"x>t"), (9, "c", "<!-- only")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract(df).collect()
    assert collections.Counter((r["page_id"], r["text"]) for r in rows)[(1, expected)] == 2
    by = {r["page_id"]: r for r in rows}
    assert by[2]["text"] == "" and by[None]["n_chars"] == 0 and by[4]["text"] == "a & b" and by[5]["text"] == "deep" and by[7]["n_chars"] == 499_999 and by[6]["text"] == "plain < text" and by[9]["text"] == ""
    assert html_text.extract(df.filter("false")).count() == 0


def test_html_of_wrapped_sections():
    part = lambda r: [f"Part {r} paragraph {k} " + "goes on with plain words " * 11 + "here." for k in range(5)]
    menu = "<div>" + "".join(f"<a href='/{k}'>Entry number {k}</a> " for k in range(4)) + "</div>"
    rows = "".join("<div class=row><div class=col>" + "".join(f"<p>{p}</p>" for p in part(r)) + "</div></div>" for r in range(3))
    text = html_text.main_text(f"<html><body>{menu}<div id=page>{rows}</div></body></html>")
    assert text == "\n\n".join(p for r in range(3) for p in part(r))


def test_html_keeps_article_parts_of_ambiguous_names():
    words = "goes on with plain words " * 11 + "here."
    parts = [f"<section id='discussion'><p>Discussion {words}</p></section>", "<h2 id='related-work'>Related work</h2>", f"<p>More {words}</p>", "<h2 id='privacy'>Privacy</h2>", f"<div id='search-results'><p>Results {words}</p></div>", f"<section class='legal'><p>Legal {words}</p></section>", f"<p id='notice-1'>Notice {words}</p>"]
    out = ["<div class='related'>" + "".join(f"<a href='/{k}'>Other article {k}</a> " for k in range(6)) + "</div>", "<div class='ad'>Buy this now and save some money today.</div>", f"<div class='comments'><p>Reader {words}</p></div>"]
    text = html_text.main_text(f"<html><body><div id=page><h1>Title</h1><p>Start {words}</p>{''.join(parts + out)}<p>End {words}</p></div></body></html>")
    assert text == "\n\n".join(["Title", f"Start {words}", f"Discussion {words}", "Related work", f"More {words}", "Privacy", f"Results {words}", f"Legal {words}", f"Notice {words}", f"End {words}"])


def article_of(page):
    """The text of a page's article element, from its markup alone."""
    stack = [html_text.parse(page)]
    while stack:
        node = stack.pop()
        if not isinstance(node, str):
            if node.tag == "article":
                return "\n\n".join(html_text.blocks(node))
            stack += node.children


def test_html_articles_come_out_whole(monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    wanted = [article_of(p) for p in pages]
    assert [html_text.main_text(p) for p in pages] == wanted
    monkeypatch.setattr(html_text, "NAMED", re.compile("(?!)"))  # density and tags only
    found = [html_text.main_text(p) for p in pages]
    assert sum(a == b for a, b in zip(found, wanted)) >= 0.95 * len(pages) and all(b in a for a, b in zip(found, wanted))
    monkeypatch.setattr(html_text, "FURNITURE", frozenset("script style noscript head title template".split()))  # density only
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert all(b in html_text.main_text(p) for p, b in zip(plain, wanted))


@pytest.mark.parametrize("name", ["content share", "legal", "privacy", "related-work", "form", "popular", "alert", "sidebar-left main", "comments"])
def test_html_name_of_the_wrapper_deletes_nothing(name):
    words = "goes on with plain words " * 11 + "here."
    parts = ["Title", *[f"Paragraph {k} {words}" for k in range(6)]]
    body = f"<h1>Title</h1><ul>{''.join(f'<li><a href=/{k}>Go to {k}</a></li>' for k in range(5))}</ul>" + "".join(f"<p>{p}</p>" for p in parts[1:])
    beside = "<div>Subscribe now to our weekly letter</div><nav><a href='/'>Home</a></nav>"
    for page in (f"<body>{beside}<article><div class='{name}'>{body}</div></article>{beside}</body>", f"<body><form id='{name}'>{beside}<div>{body}</div></form></body>"):
        assert html_text.main_text(page).replace("Go to 0\n\nGo to 1\n\nGo to 2\n\nGo to 3\n\nGo to 4\n\n", "") == "\n\n".join(parts)


def test_html_keeps_no_comments_of_readers():
    words = "goes on with plain words " * 11 + "here."
    comments = "<section id='comments'>" + "".join(f"<div class='comment'><p>Reader {k} {words}</p></div>" for k in range(4)) + "</section>"
    article = "".join(f"<p>Paragraph {k} {words}</p>" for k in range(5))
    for page in (f"<article>{article}{comments}</article>", f"<div id=page><div class=post>{article}</div>{comments}</div>"):
        assert html_text.main_text(page) == "\n\n".join(f"Paragraph {k} {words}" for k in range(5))


def test_html_of_hostile_nesting():
    import time

    for page in ("<div>" * 50_000 + "x", "<p><table><td>" + "<div>" * 50_000 + "x", "<ul><li>" * 20_000 + "x", "<p>" + "</b></i>" * 50_000 + "x", "<b>" * 50_000 + "<p>" * 5_000 + "x"):
        began = time.process_time()
        assert html_text.main_text(page) == "x" and time.process_time() - began < 5


# 5


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    return path, lambda texts: [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tokens_equal_the_library(tokens):
    path, count = tokens
    rng = random.Random(1)
    bits = ["'", "s", "t", "re", "r", "v", "ve", "ll", "l", "m", "d", " ", "  ", "\n", "\t", "\u00a0", "é", "9", "½", "٣", "中", "\u2003", "!", "--", "a", "the", "'s", "😀", "\u0301", "<|endoftext|>", "<|endof", "\x00", "aaaa", "\x85", "\u200b", "ſ", "İ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(rng.choice("abcdefghtioner ") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    texts += ["x" * 5000, " " * 3000, "ab" * 4000, "", "a " * 3000]
    assert token_counts.tokenizer(path).counts(texts).tolist() == count(texts)


def test_scan_of_chunks_is_exact():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, token_counts.N_SYMBOLS, 5000).astype(np.uint8)
    state, marks = token_counts.FREE, []
    for k, s in enumerate(symbols):
        if token_counts.STARTS[state, s]:
            marks.append(k)
        state = token_counts.TO[state, s]
    for width in (2, 8, 256, 10_000):
        assert token_counts.piece_starts(symbols, width).tolist() == marks


def test_borders_of_tokens_are_worked_out_once(tokens, vocabulary, monkeypatch):
    path, count = tokens
    texts = [" ".join(prose(random.Random(67), vocabulary, 300)) + "antidisestablishmentarianism" * 3]
    machine, made = token_counts.Tokenizer(path), []
    plain = machine._merges_later
    monkeypatch.setattr(machine, "_merges_later", lambda one, two: made.append((one, two)) or plain(one, two))
    assert machine.counts(texts).tolist() == count(texts)
    assert made and len(made) == len(set(made))
    monkeypatch.setattr(token_counts, "MAX_BORDERS", 2)
    assert token_counts.Tokenizer(path).counts(texts).tolist() == count(texts)


def test_token_counts(spark, odd, none, tokens):
    path, count = tokens
    rows = token_counts.token_counts(odd, path).collect()
    expected = collections.Counter((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(ODD, count([t or "" for _, t in ODD])))
    assert collections.Counter(tuple(r) for r in rows) == expected
    assert token_counts.token_counts(none, path).count() == 0


# 6


def base_columns(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + q for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for q in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none, vocabulary):
    rng = random.Random(8)
    good = [(k, " ".join(prose(rng, vocabulary[:300], 120))) for k in range(100, 160)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(rng, vocabulary[:300], 120))) for k in range(200, 230)]
    repeat = [(300, "one two three four five " * 30), (301, "a\nb\na\n\na # $ | é"), (302, " ".join(str(k % 40) for k in range(200)))]
    rows = ODD + good + bad + repeat
    table = odd.unionByName(docs_of(spark, good + bad + repeat), allowMissingColumns=True)
    trusted = docs_of(spark, good[:40]).select("doc_id")
    out = quality_rules.judge(table, trusted).collect()
    expected = collections.Counter((i, *base_columns(t)) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == expected
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in bad} and 300 not in kept
    same = quality_rules.keep_good(table, trusted)
    assert same.columns == table.columns and {r["doc_id"] for r in same.select("doc_id").collect()} == kept
    assert quality_rules.judge(none, trusted).count() == 0
    assert {r["kept"] for r in quality_rules.judge(odd, trusted.filter("false")).filter("base_failed").collect()} == {False}


def test_log_ratios_by_hand(spark):
    rows = [(1, "a b a"), (2, "b c"), (3, None)]
    ratios = quality_rules.log_ratios(docs_of(spark, rows), docs_of(spark, rows[:1]).select("doc_id"))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    pair = spark.sql(f"SELECT pmod(xxhash64(CAST({word('b')} AS BIGINT), CAST({word('c')} AS BIGINT)), {quality_rules.BUCKETS})").first()[0]
    size = quality_rules.BUCKETS
    tail = lambda t: spark.sql(f"SELECT pmod(xxhash64('{t}', {quality_rules.TAIL}), {quality_rules.BUCKETS})").first()[0]
    # Raw: words a 2, b 2, c 1, as many ends of words, and three pairs; trusted: a 2, b 1, as many ends, and two pairs.
    more = quality_rules.SHARE / size + quality_rules.COUNT / 13
    for bucket, raw, good in ((word("a") % size, 2, 2), (word("c") % size, 1, 0), (pair, 1, 0), (tail("b"), 2, 1)):
        assert abs(ratios[bucket] - np.log((good / 8 + more) / (raw / 13 + more))) < 1e-12


def test_quality_verdicts_by_hand(spark, vocabulary):
    rng = random.Random(12)
    texts = {k: prose(rng, vocabulary[:900], 150) for k in range(60)}
    texts |= {k: [w + rng.choice(["***", "%%%", "###"]) for w in prose(rng, vocabulary[:900], 150)] for k in range(100, 104)}
    texts |= {k: [x for w in prose(rng, vocabulary[:900], 75) for x in (w, "|")] for k in range(104, 108)}
    texts[200] = [f"{rng.random()}" for _ in range(120)]  # nothing in it is common: no evidence against it
    docs = docs_of(spark, [(k, " ".join(w)) for k, w in texts.items()])
    trusted = docs.filter("doc_id < 30").select("doc_id")
    ratios = quality_rules.log_ratios(docs, trusted)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    size, hashed = quality_rules.BUCKETS, {}
    grams = {k: [*w, *[(a, b) for a, b in zip(w, w[1:])], *[[x[-3:]] for x in w]] for k, w in texts.items()}
    flat = sorted({(a, b) for w in texts.values() for a, b in zip(w, w[1:])})
    h = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    pairs = spark.createDataFrame([(a, b, h(a), h(b)) for a, b in flat], "a string, b string, x bigint, y bigint")
    hashed |= {(r["a"], r["b"]): r["n"] for r in pairs.selectExpr("a", "b", f"pmod(xxhash64(x, y), {size}) n").collect()}
    tails = spark.createDataFrame(sorted({(x[-3:],) for w in texts.values() for x in w}), "t string")
    hashed |= {r["t"]: r["n"] for r in tails.selectExpr("t", f"pmod(xxhash64(t, {quality_rules.TAIL}), {size}) n").collect()}
    for r in quality_rules.judge(docs, trusted).collect():
        score = np.mean([ratios[hashed[g] if isinstance(g, tuple) else hashed[g[0]] if isinstance(g, list) else h(g) % size] for g in grams[r["doc_id"]]])
        assert abs(r["llr"] - score) < 1e-9
        assert r["kept"] == (not r["base_failed"] and score >= quality_rules.THRESHOLD) == (not 100 <= r["doc_id"] < 108)


# 7


def brute_contamination(docs, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = fold(text)
        k = min(10, len(w))
        windows += [(item, w[p : p + k]) for p in range(len(w) - k + 1)] if w else []
    out = []
    for doc, text in docs:
        w, hit, ids = fold(text), set(), set()
        for item, key in windows:
            for p in range(len(w) - len(key) + 1):
                if w[p : p + len(key)] == key:
                    hit |= set(range(p, p + len(key)))
                    ids |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(ids), len(hit) > 0))
    return out


@pytest.mark.parametrize("max_bytes", [1 << 20, 120])
def test_contamination(spark, odd, none, vocabulary, max_bytes):
    rng = random.Random(6)
    items = [(k, " ".join(prose(rng, vocabulary, n))) for k, n in enumerate([25, 10, 4, 12, 1])] + [(7, None), (8, "!!"), (None, "null item has some words")]
    texts = [prose(rng, vocabulary, 80) for _ in range(12)]
    texts[2][10:10] = items[0][1].upper().split()
    texts[3][:0] = items[1][1].split()[:9]
    texts[4] += items[2][1].split()
    texts[5][5:5] = items[0][1].split()[3:14] + items[3][1].split()
    texts[6][0:0] = "null item has some words".split()
    rows = ODD + [(100 + k, ", ".join(t)) for k, t in enumerate(texts)]
    table = odd.unionByName(docs_of(spark, rows[len(ODD) :]), allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontamination.contamination(table, bench, max_bytes=max_bytes).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out) == collections.Counter(brute_contamination(rows, items))
    spans = decontamination.scan(table, bench, max_bytes=max_bytes).filter("doc_id = 102").first()["spans"]
    text = dict(rows)[102]
    assert ", ".join(items[0][1].upper().split()) in [text[s["first"] : s["last"]] for s in spans]
    clean = decontamination.drop_contaminated(table, bench, max_bytes=max_bytes)
    assert clean.columns == table.columns and clean.count() == sum(not r["contaminated"] for r in out)
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(odd, bench.filter("false")).filter("contaminated").count() == 0


# 8


def test_toxicity(spark, odd, none, vocabulary):
    rng = random.Random(4)
    rude = ["zunkel", "zunkelig", "brottle", "brottles", "mirpo"]
    rows, labels = [], []
    for k in range(500):
        toxic = k % 5 == 0
        words = prose(rng, vocabulary, rng.randint(20, 200))
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((1000 + k, " ".join(words)))
        labels.append((1000 + k, int(k % 7 > 0), int(toxic)))
    table = odd.unionByName(docs_of(spark, rows), allowMissingColumns=True)
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1, 1), (1, None, 1), labels[1]], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.classify(table, known).collect()}
    held = [x for x in labels if x[0] % 4 == 0]
    assert sum(out[i]["toxic"] == bool(t) for i, _, t in held) >= 0.97 * len(held)
    assert 0 <= out[1]["toxic_p"] <= 1 and not out[2]["toxic"]
    assert toxicity.classify(none, known).count() == 0
    assert {r["toxic"] for r in toxicity.classify(odd, known.filter("false")).collect()} == {False}


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 400
    first = rng.integers(0, 2, n)
    flat = np.array([x for k in range(n) for x in sorted({int(first[k]), 10 + int(rng.integers(0, 50))})], np.int32)
    model = toxicity.fit_chain([str(k) for k in range(n)], flat, np.full(n, 2), np.column_stack((first, first)))
    assert len(model) == 2 and model[1].earlier.shape == (1,) and model[1].earlier[0] > 0


# 9


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train(spark)


def test_bound_loses_nothing(spark, vocabulary, license_model):
    rng = random.Random(5)
    flat = [w for ps in [*licenses.TEMPLATES.values(), licenses.UNKNOWN, licenses.FRAMES, *licenses.NOTICES.values()] for p in ps for w in p.split()]
    line = lambda: " ".join(rng.choice(flat) if rng.random() < 0.6 else rng.choice(vocabulary) for _ in range(rng.randint(1, 14)))
    phrase = lambda: rng.choice(rng.choice(list(licenses.TEMPLATES.values())))
    texts = ["\n".join(rng.choice([line, line, phrase, lambda: ""])() for _ in range(rng.randint(1, 8))) for _ in range(150)]
    docs = docs_of(spark, list(enumerate(texts)))
    one, two = (sorted(map(tuple, licenses.scan(docs, model=license_model, bound=b).collect())) for b in (True, False))
    assert one == two and sum(r[4] for r in one) > 30


def test_licenses(spark, odd, none, license_model):
    rows = [
        (10, "Some prose.\nReleased under the MIT License.\nmore", "MIT"),
        (11, "Licensed under the Apache License, Version 2.0.", "Apache"),
        (12, "This work is licensed under the GNU General Public License, version 3.", "GPL"),
        (13, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC"),
        (14, "Licensed under CC BY 4.0", "CC-BY"),
        (15, "This library is under the GNU Lesser General Public License", "LGPL"),
        (16, "He lost his driving license on the road.", ""),
        (17, "The general public was invited; permission was granted.", ""),
        (18, "MIT License\nApache License Version 2.0", "Apache,MIT"),
    ]
    table = odd.unionByName(docs_of(spark, [r[:2] for r in rows]), allowMissingColumns=True)
    out = {r["doc_id"]: r for r in licenses.scan(table, model=license_model).collect()}
    assert {i: out[i]["families"] for i, _, _ in rows} == {i: f for i, _, f in rows}
    assert out[13]["n_licence"] == 2 and out[10]["n_paragraphs"] == 3 and out[1]["n_paragraphs"] == 0 and not out[4]["licensed"]
    assert licenses.scan(table, model=license_model).count() == len(ODD) + len(rows)
    assert licenses.scan(none, model=license_model).count() == 0


def test_license_plan_holds_small_tables(spark, license_model):
    docs = docs_of(spark, [(1, "licensed under the mit license")])
    assert len(licenses.scan(docs, model=license_model)._jdf.queryExecution().optimizedPlan().toString()) < 500_000
    used = {b: k + 1 for k, b in enumerate(license_model.features) if any(w[k] for w in license_model.weights)}
    starts, table = licenses._packed(used, 13)
    found = {b: table[b // licenses.HALF + starts[b % licenses.HALF]] ^ b << 13 for b in range(licenses.SIZE)}
    assert {b: k for b, k in found.items() if 0 < k < 1 << 13} == used and len(license_model.features) < 1 << 13


def test_wrapped_licenses(spark, license_model):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    rows = [
        (1, f"Some prose.\n\n{isc}", "ISC", 1),
        (2, "licensed under a Creative Commons\nAttribution 4.0 International License", "CC-BY", 1),
        (3, "under the GNU General\nPublic License", "GPL", 1),
        (4, "under the GNU General\n \nPublic License", "", 0),
        (5, "# This file is under the GNU\n# General Public License.\n\nMIT License\nmore", "GPL,MIT", 2),
        (6, "The general\npublic was invited", "", 0),
    ]
    out = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, [r[:2] for r in rows]), model=license_model).collect()}
    assert [(k, out[k]["families"], out[k]["n_licence"]) for k, *_ in rows] == [(k, f, n) for k, _, f, n in rows]
    assert out[1]["n_paragraphs"] == 4 and licenses.scan(docs_of(spark, [r[:2] for r in rows]), model=license_model).count() == len(rows)


def test_held_out_license_paragraphs(spark, license_model):
    frames = ["available under the {}", "the code comes with the {} attached", "distributed under {}"]
    rows = [(k, f.format(p), n) for k, (n, p, f) in enumerate((n, p, f) for n, ps in licenses.TEMPLATES.items() for p in ps for f in frames)]
    out = {r["doc_id"]: r["families"] for r in licenses.scan(docs_of(spark, [r[:2] for r in rows]), model=license_model).collect()}
    assert sum(out[i] == n for i, _, n in rows) >= 0.9 * len(rows)


# 10


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[p : p + k]).encode(), 42) for p in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd, none, vocabulary):
    rng = random.Random(7)
    rows = list(ODD)
    for k in range(40):
        words = prose(rng, vocabulary, 150)
        for c in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((1000 + 10 * k + c, " ".join(copy)))
    table = odd.unionByName(docs_of(spark, rows[len(ODD) :]), allowMissingColumns=True)
    out = simhash.near_duplicates(table, tile=16).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    expected = collections.Counter((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group))
    assert collections.Counter(tuple(r) for r in out) == expected
    kept = simhash.keep_one(table, tile=16)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {x for x in least.values() if x is not None}
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_tiles_compare_exactly():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(int(b))) for b in rng.integers(0, 64, 6)] + [base]))
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    left, right = values[:100], values[100:]
    a, b = simhash.compare(left, right, 4)
    joined = collections.defaultdict(set)
    for x, y in zip(a.tolist(), b.tolist()):
        joined[y] |= {x, y}
    near = {(int(x), int(y)) for x in left for y in right if bin(int(x) ^ int(y)).count("1") <= 4}
    assert all(any({x, y} <= g for g in joined.values()) for x, y in near)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    out = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert out == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
