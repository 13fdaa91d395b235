"""Operators that compare the rows of a table, against brute force over small tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.llm import components, ngram_jaccard, quality_rules, sharding, substring_dedup
from quaero.llm import words as word_hashes
from tests.llm.conftest import ODD, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, size):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(texts, size, percent):
    """Position -> smallest position reachable by links."""
    sets = [shingle_set(t, size) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(texts))]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.integers(0, len(w))] = f"edit{rng.integers(0, 10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_copies(spark):
    """Copies with few and many edits, chains of them, common passages, and short texts."""
    rng = np.random.default_rng(11)
    passage = words(60, 900)
    texts = []
    for k in range(12):
        base = words(int(rng.integers(8, 200)), 1000 + k)
        if k % 3 == 0:
            base = f"{base} {passage}"
        texts += [edited(rng, base, int(n)) for n in rng.integers(0, max(2, len(base.split()) // 12), 9)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, max(1, len(base.split()) // 40))
            texts.append(chain)
    texts += [f"{passage} {words(6, 2000 + k)}" for k in range(25)]  # hardly anything but the passage
    texts += ["one two three", "one two three", "one two", "one", "", None, "ONE two THREE"]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_groups_are_those_of_brute_force(near_copies, size, percent, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "COMMON_SHARE", 0.05)
    texts, df = near_copies
    expected = brute_groups(texts, size, percent)
    got = {r["doc_id"]: r for r in ngram_jaccard.jaccard_groups(df, size=size, percent=percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == expected
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(shingle_set(t, size)) for t in texts]
    kept = sorted(r["doc_id"] for r in ngram_jaccard.first_of_groups(df, size=size, percent=percent).collect())
    assert kept == sorted(set(expected))


def test_similar_sets_always_share_a_key():
    """With and without common shingles, whatever part of a set they are."""
    rng = np.random.default_rng(2)
    for _ in range(600):
        percent = int(rng.choice([60, 80, 85, 95]))
        universe = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = int(rng.integers(2, 300))
        a = rng.choice(universe, n, replace=False)
        most = max(1, n * (100 - percent) // 100)
        swap, grow = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        b = np.unique(np.r_[a[swap // 2 :], rng.choice(universe, swap // 2 + grow)])
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared) or np.array_equal(a, b):
            continue
        part = rng.choice([0, 0.3, 0.7, 0.9, 1.0])
        both = np.union1d(a, b)
        common = np.sort(rng.choice(both, int(part * len(both)), replace=False))
        keys = [ngram_jaccard.signatures(x, common, percent) for x in (a, b)]
        assert len(np.intersect1d(*keys)) > 0, (percent, len(a), len(b), part)


def test_jaccard_of_odd_rows(odd, none):
    rows = ngram_jaccard.jaccard_groups(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[k]["component_id"] for k in (1, 5, 9)] == [1, 1, 1]
    assert [by_id[k]["component_id"] for k in (2, 3, 4)] == [2, 3, 4]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    kept = ngram_jaccard.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8, 10, 10] and ids.count(None) == 2
    assert ngram_jaccard.jaccard_groups(none).collect() == []
    assert ngram_jaccard.first_of_groups(none).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, **{k: 200 for k in (200, 201, 202)}}
    assert components.connected_components(df.limit(0)).collect() == []


def test_word_hashes_don_t_depend_on_pieces_or_groups(documents, monkeypatch):
    texts = [r["text"] for r in documents.collect()] + ["", " ", "é\x0bÉ ÀÀ\x85x y"]
    whole = list(word_hashes.hashed_words(texts))
    sentences = list(word_hashes.sentences(texts, b".,"))
    for t, h in zip(texts, whole):
        w = WORD.findall(lower(t))
        assert len(w) == len(h) and len(set(w)) == len(set(h.tolist()))
    monkeypatch.setattr(word_hashes, "PIECE", 50)
    monkeypatch.setattr(word_hashes, "GROUP", 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, word_hashes.hashed_words(texts)))
    for a, b in zip(sentences, word_hashes.sentences(texts, b".,")):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def plain_sentences(text):
    out, now = [], []
    for m in WORD.finditer(text):
        now.append(lower(m[0]))
        space = re.match(r"[\x20\x09-\x0D]*", text[m.end() :])[0]
        if m[0].encode()[-1:] in [bytes([c]) for c in substring_dedup.MARKS] or "\n" in space:
            out.append(tuple(now))
            now = []
    return [*out, tuple(now)] if now else out


def test_repeated_passages_are_those_of_brute_force(documents):
    split = {r["doc_id"]: plain_sentences(r["text"]) for r in documents.collect()}
    run, least = substring_dedup.RUN, substring_dedup.RUN_WORDS
    first = {}
    for d in sorted(split):
        for i in range(len(split[d]) - run + 1):
            if sum(map(len, key := tuple(split[d][i : i + run]))) >= least:
                first.setdefault(key, (d, i))
    changed = 0
    for r in substring_dedup.remove_repeats(documents).collect():
        s = split[r["doc_id"]]
        gone = {
            i + j
            for i in range(len(s) - run + 1)
            for j in range(run)
            if first.get(tuple(s[i : i + run]), (r["doc_id"], i)) != (r["doc_id"], i)
        }
        assert (r["n_sentences"], r["n_removed"]) == (len(s), len(gone))
        kept = [w for k, words_ in enumerate(s) for w in words_ if k not in gone]
        assert WORD.findall(lower(r["text"])) == kept
        changed += bool(gone)
    assert changed


def test_hot_passages_are_split(spark, monkeypatch):
    passage = "alpha beta gamma delta, epsilon zeta eta theta iota. kappa lambda mu nu, xi omicron pi rho."
    docs = spark.createDataFrame([(k, f"{words(15, k)}. {passage} {words(15, 500 + k)}.") for k in range(60)], "doc_id long, text string")
    plain = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    real = max
    monkeypatch.setattr(substring_dedup, "max", lambda *_: 20, raising=False)  # hot from 20 on
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs).collect())) == plain
    assert real(t[2] for t in plain) >= 3 and "kappa" in plain[0][3] and "kappa" not in plain[1][3]


def passage_cases():
    """Passages of 51 words in other text: without marks, with marks behind symbols, and in Chinese."""
    rng = np.random.default_rng(8)
    cases = []
    for k in range(60):
        mark = ("", '."', ".###", "।", "؟")[k % 5]
        passage = [w + mark * (i % 7 == 6) for i, w in enumerate(words(51, 3000 + k).split())]
        texts = []
        for j in range(2):
            n, m = rng.integers(0, 40, 2)
            texts.append(" ".join([*words(int(n), 4000 + 2 * k + j).split(), *passage, *words(int(m), 5000 + 2 * k + j).split()]))
        cases.append((texts, passage))
    for k in range(20):
        own = lambda n: "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 20_000, n))
        passage = own(51)
        cases.append(([own(30) + passage + own(9), own(5) + passage + own(40)], list(passage)))
    return cases


def test_any_passage_of_over_50_words_is_found(spark):
    """The second place loses words of the passage, at most AMONG - 1 stay at an end, and nothing else goes."""
    cases = passage_cases()
    docs = spark.createDataFrame([(2 * k + j, t) for k, (texts, _) in enumerate(cases) for j, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, windows=True).collect()}
    for k, (texts, passage) in enumerate(cases):
        assert got[2 * k]["text"] == texts[0]
        glue = " " if " " in texts[1] else ""
        joined = glue.join(passage)
        before, behind = texts[1].split(joined)
        left = got[2 * k + 1]["text"]
        assert got[2 * k + 1]["n_removed"] > 0 and left.startswith(before) and left.endswith(behind.strip())
        stays = left[len(before) : len(left) - len(behind)]
        assert len(stays.split() if glue else stays) <= 2 * (substring_dedup.AMONG - 1)


def test_a_repeated_sentence_without_end_goes_whole(spark):
    text = words(5_000, 77)
    docs = spark.createDataFrame([(1, text), (2, text), (3, "ha " * 200)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs, windows=True).collect()}
    assert got[1] == (0, text) and got[2] == (1, "")
    assert got[3] == (1, "ha " * substring_dedup.WINDOW)  # the first window stays whole


def test_repeats_of_odd_rows(odd, none):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD)
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert substring_dedup.remove_repeats(none).collect() == []
    rows = substring_dedup.remove_repeats(odd, windows=True).collect()
    assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] in (5, 9)] == ["", ""]
    assert substring_dedup.remove_repeats(none, windows=True).collect() == []


def test_repeated_rows_count_as_one(spark):
    text = "a b c d e, f g h i j. k l m n o! p q r s t."
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(1, 0, text), (1, 0, text), (2, 4, "")]


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(documents, n_shards):
    rows = sharding.shard_rows(documents, n_shards).collect()
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(n_shards))
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_most_rows_stay_in_their_shard(documents):
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(documents, 8).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(documents, 9).collect()}
    # the least is 1 in 9; overflowing adds some
    assert sum(before[d] != after[d] for d in before) < 0.45 * len(before)


def test_rows_go_to_the_first_shard_with_room(documents):
    """The same as walking the ring arc by arc, in rounds."""
    n = 5
    points = sharding.ring(n)
    rows = sharding.shard_rows(documents, n).collect()
    import hashlib
    from bisect import bisect_left

    def arc(r):
        point = int(hashlib.sha256(str(r["doc_id"]).encode()).hexdigest()[:8], 16)
        return bisect_left([p for p, _ in points], point) % len(points)

    orders = sharding.preferences(points, n)
    by_arc = defaultdict(Counter)
    for r in rows:
        by_arc[arc(r)][r["shard"]] += 1
    counts = [sum(by_arc[k].values()) for k in range(len(points))]
    for k, parts in enumerate(sharding.stretches(counts, orders, n)):
        ends = [p[0] for p in parts[1:]] + [counts[k]]
        assert by_arc[k] == Counter({p[1]: end - p[0] for p, end in zip(parts, ends)})
    assert sum(by_arc[k][orders[k][0]] for k in by_arc) > 0.6 * len(rows)


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_rows(odd, 4).collect()
    assert len(rows) == len(ODD)
    sizes = sorted(r["size"] for r in rows)
    assert sizes == sorted(len((r[1] or "").encode()) + 1 for r in ODD)
    assert {r["text_crc32"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert sharding.shard_rows(none).collect() == []


def plain_statistics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_of_documents(documents, odd):
    extra = [
        "a b c d e a b c d e a b c d e", "x x x x x x x x x x x x", "\x0b\x0c a\x1cb   c\r\n", "l 1\n\nl 1\nl 1 \n",
        "🙂🙂 #*$ %&|<>\t<", "a b c d e f g h a b c d e f g h x",
    ]
    more = documents.sparkSession.createDataFrame([(10_000 + i, t, "en", "s") for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string")
    for df in (documents.select(more.columns).union(more), odd):
        rows = quality_rules.quality_verdicts(df).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        got = sorted((r["doc_id"] or -1, *(r[n] for n in names)) for r in rows)
        assert got == sorted((r["doc_id"] or -1, *plain_statistics(r["text"])) for r in df.collect())
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_quality_of_no_rows(none):
    assert quality_rules.quality_verdicts(none).collect() == []


def brute_mcd(x, h):
    """The better of the two starts after the same concentration steps, in plain arrays."""
    floor = np.diag(np.square(quality_rules.FLOORS))

    def improved(mean, cov):
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(quality_rules.BINS * np.log2(1 + d))
            cut = np.sort(bins)[h - 1]
            near = x[bins <= cut]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + floor
        return np.linalg.slogdet(cov)[1], mean, cov

    middle = np.median(x, axis=0)
    mad = np.median(np.abs(x - middle), axis=0)
    starts = [(x.mean(0), np.cov(x.T, bias=True) + floor), (middle, np.diag(np.square(1.4826 * mad)) + floor)]
    _, mean, cov = min((improved(*s) for s in starts), key=lambda e: e[0])
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    near = x[d <= quality_rules.ACCEPT * quality_rules.CONSISTENCY]
    return near.mean(0), np.cov(near.T, bias=True) + floor


def test_covariance_estimates_are_those_of_plain_arrays(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for group, n in (("a", 400), ("b", 150)):
        x = rng.normal(0, 1, (n, 4)) @ rng.normal(0, 1, (4, 4))
        x[: n // 4] += rng.normal(12, 1, (n // 4, 4))  # a quarter of outliers
        x = np.round(x * quality_rules.STEP) / quality_rules.STEP
        rows += [(group, *map(float, v)) for v in x]
        expected[group] = brute_mcd(x, -(-n // 2))
    df = spark.createDataFrame(rows, "_group string, _x0 double, _x1 double, _x2 double, _x3 double")
    for r in quality_rules.covariance_estimates(df).collect():
        mean, cov = expected[r["_group"]]
        assert np.allclose([r[f"_m{i}"] for i in range(4)], mean)
        low = np.zeros((4, 4))
        for i, j in quality_rules.PAIRS:
            low[i, j] = r[f"_c{i}{j}"]
        assert np.allclose(low @ low.T, cov)


def test_outliers_of_a_language_and_source_are_rejected(spark):
    good = [(k, words(60 + k % 17, k), "en", f"s{k % 3}") for k in range(300)]
    bad = [(1000 + k, " ".join(f"{w}##$$" for w in words(60, 700 + k).split()), "en", "s1") for k in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(df).collect()}
    assert all(kept[d] for d, *_ in good) and not any(kept[d] for d, *_ in bad)


def test_each_statistic_alone_rejects(spark):
    def lines(k):
        return "\n".join(words(8, 50 * k + i) for i in range(12))

    good = [(k, lines(k), "en", "s") for k in range(200)]
    phrase = words(7, 99_000)
    outliers = {
        "long words": " ".join(w * 2 for w in words(96, 90_001).split()),
        "symbols": " ".join(f"{w}#" for w in words(96, 90_002).split()),
        "duplicate lines": "\n".join(f"{words(8, 90_100 + i)}\nok" for i in range(12)),
        "repeated words": f"{words(40, 90_003)} {phrase} {words(40, 90_004)} {phrase}",
    }
    df = spark.createDataFrame(good + [(1000 + k, t, "en", "s") for k, t in enumerate(outliers.values())], "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(df).collect()}
    assert all(rows[d]["kept"] for d, *_ in good)
    for k, name in enumerate(outliers):
        assert not rows[1000 + k]["base_failed"] and not rows[1000 + k]["kept"], (name, rows[1000 + k])


def test_groups_too_large_to_ship_are_joined_with_salt(spark, monkeypatch, documents):
    plain = sorted(map(str, quality_rules.quality_verdicts(documents).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert sorted(map(str, quality_rules.quality_verdicts(documents).collect())) == plain


def test_runs_python_free(documents):
    plan = quality_rules.quality_verdicts(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
