"""Set joins, scans and the pipeline against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bloom, common, components, decontam, license_scan, line_dedup, ngram_join, packing, quality, secret_scan, setjoin, toxicity
from lodestone.llm.common import Scratch, table
from lodestone.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def corpus(seed=3, groups=12):
    """Documents with copies at all distances from their group's first."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        for _ in range(rng.choice([1, 2, 8, 20])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def shingles(text, k=5):
    w = text.lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def similar(a, b, percent=75):
    o = len(a & b)
    return bool(a and b) and 100 * o >= percent * (len(a) + len(b) - o)


def small_blocks(monkeypatch, block):
    monkeypatch.setattr(setjoin, "LEAST_BLOCK", min(block, setjoin.LEAST_BLOCK))
    monkeypatch.setattr(setjoin, "BLOCK_SETS", block)


@pytest.mark.parametrize("block", [2048, 5])
def test_near_duplicates(spark, monkeypatch, block):
    """With small blocks, groups meet in pairs of blocks."""
    small_blocks(monkeypatch, block)
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [2048, 5])
def test_near_duplicates_count_all_links(spark, monkeypatch, block):
    """n_links counts every similar pair, in any division into blocks."""
    small_blocks(monkeypatch, block)
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    distinct = set(sets.values())
    want = {i: (len(s), sum(s != x and similar(s, x) for x in distinct)) for i, s in sets.items()}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["n_links"]) for r in got} == want


def test_three_similar_texts_have_three_links(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(k, f"{base} end{k}") for k in range(3)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {0: 2, 1: 2, 2: 2}


def test_near_duplicates_by_join(spark, monkeypatch):
    """Joins instead of broadcasts, and all tokens dealt as hot ones."""
    rows = spark.createDataFrame(corpus(5, 6), "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.near_duplicates(rows).collect()))
    codes = setjoin.rarity_codes
    monkeypatch.setattr(setjoin, "rarity_codes", lambda x: (codes(x)[0], 1))
    monkeypatch.setattr(setjoin, "SALT_POSTINGS", 0.1)
    monkeypatch.setattr(setjoin, "maybe_broadcast", lambda x, *_: x)
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", -1)
    monkeypatch.setattr(ngram_join, "bounded_broadcast", lambda x, *_: x)
    assert sorted(map(tuple, ngram_join.near_duplicates(rows).collect())) == want


def shared_paragraphs(n, pool=400, seed=8):
    """Texts of four paragraphs from a pool, no two of which are similar."""
    rng = random.Random(seed)
    paragraphs = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(pool * n // 1000)]
    seen, out = set(), []
    while len(out) < n:
        four = tuple(sorted(rng.sample(range(len(paragraphs)), 4)))
        if seen.isdisjoint(itertools.combinations(four, 3)):
            seen.update(itertools.combinations(four, 3))
            out.append((len(out), " ".join(paragraphs[k] for k in four)))
    return out


def test_shared_paragraphs_meet_in_proportion(spark, monkeypatch):
    """Shared passages don't tie a corpus together: visits grow like the rows."""
    visits = {}
    route = setjoin.route

    def counted(lists, classes, percent, share, scratch):
        got = scratch.save(route(lists, classes, percent, share, scratch), "counted")
        visits[classes.count()] = got.agg(F.sum("n_blocks")).first()[0] or 0
        return got

    monkeypatch.setattr(setjoin, "route", counted)
    for n in (1000, 3000):
        docs = spark.createDataFrame(shared_paragraphs(n), "doc_id long, text string")
        assert ngram_join.near_duplicates(docs).where("n_links > 0 or component_id <> doc_id").count() == 0
    assert visits[3000] <= 3.5 * max(visits[1000], 1) and visits[3000] <= 4 * 3000


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_searches(monkeypatch, percent):
    """Both searches against all pairs, with and without sides."""
    rng = np.random.default_rng(percent)
    base = [rng.choice(400, rng.integers(1, 60), replace=False) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(int(rng.choice([1, 3, 12]))):
            s = set(b.tolist()) ^ set(rng.choice(400, int(rng.integers(0, 6))).tolist())
            if s:
                sets.append(np.array(sorted(s), np.uint64))
    sets.sort(key=len)
    for side in (None, rng.integers(0, 2, len(sets))):
        want = {(q, r) for q in range(len(sets)) for r in range(q) if similar(set(sets[q].tolist()), set(sets[r].tolist()), percent) and (side is None or side[q] != side[r])}
        got = []
        setjoin.t_occurrence(sets, percent, side, lambda q: None, lambda q, them: got.extend((q, r) for r in them.tolist()))
        assert set(got) == want and len(got) == len(want)
        order = rng.permutation(len(sets))
        mixed = [sets[k] for k in order]
        sides = np.arange(len(sets)) if side is None else side[order]
        group = rng.integers(0, 2, len(sets))
        later = {q for q in range(len(mixed)) for r in range(q) if similar(set(mixed[q].tolist()), set(mixed[r].tolist()), percent) and sides[q] != sides[r] and group[q] == group[r]}
        for hits in (3, 10**6):
            monkeypatch.setattr(setjoin, "HITS", hits)
            got = setjoin.first_matches(mixed, percent, group, sides)
            assert set(got) == later and len(got) == len(later)


def test_lines_of_repeated_ids(spark):
    """Rows of one doc_id with other texts are documents of their own."""
    rows = [(5, "one two three\nalpha beta gamma"), (5, "other words here\nalpha beta gamma"), (7, "new line of seven"), (5, "one two three\nalpha beta gamma")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = {(r["doc_id"], r["text"], tuple(r["removed"])) for r in got}
    # of the two texts of id 5, that with the larger hash loses the line that both have
    texts = sorted({t for i, t in rows if i == 5}, key=lambda t: hash_of(spark, t))
    assert left == {(5, texts[0], ()), (5, texts[1].split("\n")[0], (1,)), (7, "new line of seven", ())}


def hash_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) AS h").first()["h"]


def test_ties_of_near_lines_go_by_text_hash(spark):
    """Similar, not equal, lines of one id at the same place: the row with the larger hash loses its line."""
    rows, want = [], {}
    for k in range(24):
        base = " ".join(f"w{k}x{j}" for j in range(40))
        rows += [(k, base), (k, base + " more")]
        small, large = sorted((base, base + " more"), key=lambda t: hash_of(spark, t))
        want |= {(k, small): [], (k, large): [0]}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r["doc_id"], r["text"], tuple(r["removed"])) for r in got.collect())
    assert found == sorted((k, "" if gone else t, tuple(gone)) for (k, t), gone in want.items())


@pytest.mark.parametrize("most", [300_000, -1])
def test_lines(spark, monkeypatch, most):
    """With broadcasts, and in the way for more lines than may be broadcast."""
    monkeypatch.setattr(line_dedup, "MAX_GONE_TEXTS", most)
    if most < 0:
        monkeypatch.setattr(line_dedup, "bounded_broadcast", lambda x, *_: x)
        monkeypatch.setattr(bloom, "MOST_LOG_BITS", 6)  # a filter that lets much through
    lines = [t for _, t in corpus(9)]
    docs = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]
    seen, gone = [], collections.defaultdict(list)
    for i, t in docs:
        for k, line in enumerate(t.split("\n")):
            s = shingles(line)
            if any(similar(s, x) for x in seen):
                gone[i].append(k)
            seen.append(s)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in got} == {i: gone.get(i, []) for i, _ in docs}


def test_filter_loses_no_key(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(-50, 50, 3000), rng.integers(-(2**62), 2**62, 3000), rng.integers(0, 9, 3000))]
    table = bloom.bit_table(spark.createDataFrame(rows, "doc_id long, text_hash long, line int"), len(rows))
    cols = [np.array(c) for c in zip(*rows)]
    assert bloom.contains(table, bloom.line_keys(*cols)).all()
    assert bloom.contains(table, bloom.line_keys(cols[0], cols[1] + 1, cols[2])).mean() < 0.03
    assert not bloom.contains(bloom.bit_table(spark.createDataFrame([], "doc_id long, text_hash long, line int"), 0), bloom.line_keys(*cols)).any()


def test_hot_tokens_are_salted():
    codes = np.full(1 << setjoin.BUCKET_BITS, 40, np.uint8)
    h = setjoin.mix(np.arange(50, dtype=np.uint64))
    keys = setjoin.ordered_keys(h, codes)
    ids = setjoin.mix(np.arange(1000, 1050, dtype=np.uint64))
    cold = dict(setjoin.pack_postings(np.repeat(keys[:1], 50), ids, 64, 63))
    hot = dict(setjoin.pack_postings(np.repeat(keys[:1], 50), ids, 64, 40))
    assert len(cold) == 1 and len(hot) > 10  # 2**20 postings by the code
    assert sum(len(setjoin.unpacked([x])[0]) for x in hot.values()) == 50


@pytest.mark.parametrize("most", [-1, 200_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", most)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, rng.randrange(200, 260)) for _ in range(40)] + [(3, 3), (1, 2), (2, 1)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["root"] for r in components.connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for x in up if x != 3}
    assert components.connected_components(df.limit(0), Scratch(spark, "t")).collect() == []


def test_decontamination(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: decontam.WORD.findall((t or "").translate(low))
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    got = {r["doc_id"]: r for r in decontam.digest(decontam.contamination(docs, items)).collect()}
    for r in docs.collect():
        w = words(r["text"])
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    ids |= windows[x]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"]) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())


def test_licences_by_brute_force(spark):
    """A slow matcher that compares word lists, over a whole table."""
    sentence = {k: re.findall(r"[a-z0-9]+", s.lower()) for k, s in license_scan.SENTENCES.items() if len(s.split()) < 16 and not k.startswith("tag-")}
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in license_scan.digest(license_scan.find_licenses(docs)).collect()}
    single = {keys[0]: name for name, keys in license_scan.RULES if len(keys) == 1}
    seen = set()
    for r in docs.collect():
        lines = [re.findall(r"[a-z0-9]+", x.lower()) for x in re.split(r"(?<=[.!?:;])\s+|\n", r["text"] or "")]
        want = {single[k] for k, words in sentence.items() if k in single and words in [x for x in lines] + [a + b for a, b in zip(lines, lines[1:])]}
        assert got[r["doc_id"]] == want, r["doc_id"]
        seen |= want
    assert len(seen) >= 4


def test_secrets_by_brute_force(spark):
    """The contract's expressions, searched plainly in every text of a table."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.find_secrets(docs)).collect()}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    total = 0
    for r in docs.collect():
        t = r["text"] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(k == x for _, k, _ in found) for x in range(3)]
        total += len(found)
    assert total


def test_packing_by_brute_force(spark):
    """Every column recomputed from the unchanged tokenizer, over a whole table."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_path())
    docs = table(spark, SF, "documents")
    want = {r["doc_id"]: full.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    rows = sorted(packing.pieces_digest(packing.pack(docs, tokenizer_path())).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, used = 0, collections.Counter()
    for r in rows:
        assert (r["sequence_id"], r["offset"]) == divmod(at, 2048) and r["offset"] + r["length"] <= 2048
        ids = want[r["doc_id"]]
        assert r["start"] == used[r["doc_id"]] and r["doc_tokens"] == len(ids)
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        used[r["doc_id"]] += r["length"]
        at += r["length"]
    assert used == {i: len(x) for i, x in want.items()}


def held_out(spark, scores, column, mod, rem):
    """Recall and false alarms at the threshold, on labels never learned from."""
    labels = {r["doc_id"]: r[column] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in scores.collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rem) for r in rows)
    rows = [r for r in rows if r["held_out"]]
    of = lambda y: [r["predicted"] for r in rows if labels[r["doc_id"]] == y]
    return sum(of(1)) / len(of(1)), sum(of(0)) / len(of(0))


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    caught, alarms = held_out(spark, quality.quality_scores(docs, labels), "quality", 4, 2)
    assert caught >= 0.95 and alarms <= 0.1
    # of the 18 held-out toxic texts two hold no word of the toxic vocabulary
    caught, alarms = held_out(spark, toxicity.toxicity_scores(docs, labels), "toxic", 3, 1)
    assert caught >= 16 / 18 and alarms <= 0.02


def test_group_mentions_stay_clean():
    """Swapping or adding an identity term hardly moves a score."""
    rng = random.Random(2)
    sample = []
    vocabulary = ["awful", "vile", *sorted(toxicity.TERMS)]
    for i in range(300):
        bad = i % 5 == 0
        w = {f"t{rng.randrange(50)}" for _ in range(20)} | ({rng.choice(["awful", "vile"])} if bad else set())
        named = bad and rng.random() < 0.6  # the label goes along with a group in this sample
        found = w | ({"muslims"} if named else set())
        places = np.array([k for k, v in enumerate(vocabulary) if v in found], np.int32).tobytes()
        sample.append((places, ((("muslims",),) if named else ()), int(bad)))
    biased = toxicity.fit_counterfactual(sample, vocabulary, penalty=0.0)
    fair = toxicity.fit_counterfactual(sample, vocabulary, penalty=20.0)
    gap = lambda m: m.score("the muslims came home") - m.score("the people came home")
    assert gap(fair) < 0.5 * gap(biased) and fair.score("the muslims came home") < 0.7
    assert fair.score("an awful thing") > fair.score("the muslims came home")


def test_features_of_words():
    """Some statistics against plain counting, in one slice and in many."""
    texts = [r for _, r in corpus(2)][:40] + ["", " \n\t ", "A a A | b.\nA a. 7 #!", "x" * 50]
    got = quality.features(texts)
    for t, f in zip(texts, got):
        w = t.split()
        c = collections.Counter(w)
        n = max(1, len(w))
        want = {0: np.log1p(len(w)) / 10, 5: len(c) / n, 6: len({x.lower() for x in c}) / n, 8: sum(a == b for a, b in zip(w, w[1:])) / n, 9: max(c.values(), default=0) / n, 10: sum(k for _, k in c.most_common(3)) / n, 14: sum(not any(map(str.isalnum, x)) for x in w) / n, 21: len(set(t.split("\n"))) / len(t.split("\n")), 23: float(not w)}
        assert all(abs(f[k] - v) < 1e-9 for k, v in want.items()), t
    one_by_one = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(got, one_by_one)


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (400, 3))
    m = quality.fit_nnpu(good[:200], np.concatenate([good[200:], bad[:200]]), prior=0.5)
    assert (m.scores(good) > 0.5).mean() > 0.9 and (m.scores(bad) < 0.5).mean() > 0.9


def near_survivors(texts):
    """The least id of each group of similar texts, by comparing all pairs; equal sets with a shingle are linked too."""
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ascii_lower))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if similar(sets[a], sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i for i in texts if find(i) == i}


def test_pipeline(spark):
    """Every stage's survivors against its own decisions, in plain Python."""
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert rows and rows.items() <= kept.items(), name
        if name == "exact dedup":
            best = {}
            for i, t in kept.items():
                key = t.encode().lower()
                best[key] = max(i, best.get(key, i))
            assert set(rows) == set(best.values())
        if name == "quality classifier":
            scored = quality.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels"))
            assert set(rows) == {r["doc_id"] for r in scored.where("predicted = 1").collect()} != set(kept)
        if name == "n-gram Jaccard join":
            assert set(rows) == near_survivors(kept) != set(kept)
        if name == "benchmark decontamination":
            assert not [r for r in decontam.contamination(docs, table(spark, SF, "benchmark")).collect() if r["n_hit"]]
        kept = rows
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == set(kept)
    whole = cp.run(spark, SF)
    key = lambda df: {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.select("doc_id", "start", "length", "ids_crc32").collect() if r["start"] == 0 and r["doc_id"] % 7 == 0}
    assert {k[0] for k in key(whole)} == {i for i in kept if i % 7 == 0}


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: every row stands for itself."""
    import corpus_pipeline as cp

    passage = " ".join(f"bench{i}" for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = " ".join(f"w{i}" for i in range(60))

    def left(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)

    want = lambda rows: sorted(rows, key=repr)
    tagged = lambda rows: [(i, t, "x") for i, t in rows]
    exact = [(None, "n"), (None, "N"), (None, "b"), (5, "a"), (5, "B"), (7, "b"), (8, "same"), (8, "same"), (9, None), (9, None), (3, "")]
    assert left(cp.exact_stage, tagged(exact)) in [want([(None, t), (5, "a"), (7, "b"), (8, "same"), (9, None)]) for t in "nN"]
    near = [(None, base + " p"), (4, base + " q"), (4, "quite another text"), (6, base + " r"), (None, "x y"), (None, "x  y"), (None, None), (2, "a b"), (2, "a  b")]
    got = left(cp.near_stage, tagged(near))
    assert sorted(t for i, t in got if i == 4) == ["quite another text", base + " q"] and 6 not in [i for i, _ in got]
    assert sorted(str(t).split() for i, t in got if i is None) == [["None"], ["x", "y"]]
    assert [i for i, _ in got].count(2) == 1
    dirty = [(None, f"see {passage}"), (None, "clean"), (5, passage), (5, "clean too"), (6, None)]
    assert left(cp.decontamination_stage, tagged(dirty)) == want([(None, "clean"), (5, "clean too"), (6, None)])


def test_pipeline_stages_on_empty_and_clashing_tables(spark, tmp_path):
    import corpus_pipeline as cp

    base = " ".join(f"w{i}" for i in range(60))
    texts = [(1, base + " a"), (2, base + " b"), (3, "same"), (4, "SAME"), (5, "bench one two"), (6, None), (7, "w " * 20000)]
    spark.createDataFrame([(9, "bench one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["sha", "doc", "keep_id", "kept", "keeping", "row", "id", "best", "component_id", "n", "part", "ids", "norm", "h", "score", "label"]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    clash = plain.select("*", *(F.lit(k).alias(x) for k, x in enumerate(names)))
    for name, stage in cp.STAGES:
        empty = stage(spark, plain.limit(0), str(tmp_path))
        assert empty.count() == 0, name
        got = stage(spark, clash, str(tmp_path))
        if name != "packing":
            assert empty.columns == plain.columns and got.columns == clash.columns, name
        ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").distinct().collect())
        left = ids(stage(spark, plain, str(tmp_path)))
        assert ids(got) == left, name
        want = {"exact dedup": [1, 2, 4, 5, 6, 7], "n-gram Jaccard join": [1, 3, 5, 6, 7], "benchmark decontamination": [1, 2, 3, 4, 6, 7], "packing": [1, 2, 3, 4, 5, 6, 7]}
        assert left == want.get(name, left), name
