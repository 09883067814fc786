"""Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns, with brute force where results are exact."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewise.llm import decontaminate, embeddings, jaccard, langid, lines, packing, sharding, substrings, toxicity, urls
from tonewise.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, k string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, "k", 1) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return table(spark, [(1, None, "en"), (2, "", None), (3, " \n ", "en"), (4, long, "en"), (4, long, "en"), (None, "alpha beta gamma delta epsilon", "de"), (5, "12345", "de")])


BENCH = "item_id long, text string, w string"


def runs(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "w1 w2 w3", "x"), (None, "w5", "x"), (2, None, "x")], BENCH)
    return {
        "lines": lambda d: lines.report(d),
        "toxicity": lambda d: toxicity.report(d, labels),
        "sharding": lambda d: sharding.report(d),
        "packing": lambda d: packing.report(d),
        "substrings": lambda d: substrings.report(d),
        "decontaminate": lambda d: decontaminate.report(d, bench),
        "langid": lambda d: langid.report(d),
        "jaccard": lambda d: jaccard.report(d),
    }


@pytest.mark.parametrize("name", ["lines", "toxicity", "sharding", "packing", "substrings", "decontaminate", "langid", "jaccard"])
def test_odd_and_empty_tables(spark, odd, name):
    run = runs(spark)[name]
    got = run(odd).collect()
    if name not in ("packing", "substrings"):
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "4", "5", "None"]
    assert run(odd.limit(0)).count() == 0


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdeé ", k=24)).strip() + "." for _ in range(6)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 4)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                j, what = rng.randrange(len(s)), rng.randrange(3)
                s[j : j + (what < 2)] = [] if what == 0 else [rng.choice("xyé")]
            text.append("".join(s))
        rows.append((i, "\n".join(text + ["", "short"]), "en"))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    seen, want = [], {}
    for i, text, _ in rows:
        left = []
        for line in text.split("\n"):
            gone = line.strip(" ") and any(s == line or min(len(s), len(line)) >= 20 and near(s, line) for s in seen)
            seen += [line] if line.strip(" ") else []
            left += [] if gone else [line]
        want[i] = "\n".join(left)
    got = {r["doc_id"]: r["text"] for r in lines.dedup(table(spark, rows)).collect()}
    assert all(want[i] == t for i, t in got.items())
    assert all(not want[i].strip() for i in want if i not in got)


@pytest.mark.parametrize("n, pct", [(4, 85), (5, 80), (1, 85)])
def test_jaccard_by_brute_force(spark, n, pct):
    rng = random.Random(n)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 30)}" for _ in range(rng.choice([2, 3, 8, 15, 40, 120]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 3)}"
            rows.append((len(rows), " ".join(w), "en"))
    sets = []
    for _, t, _ in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["id"]: (r["n"], r["cid"]) for r in jaccard.classes(table(spark, rows), n, pct).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(rows))}
    assert jaccard.one_of_each(table(spark, rows), n, pct).count() == len({find(i) for i in range(len(rows))})


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        w = base[: rng.randint(80, 100)]
        w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "en"))
    sets = [frozenset(t.split()[j : j + 2][0] + " " + t.split()[j + 1] for j in range(len(t.split()) - 1)) for _, t, _ in rows]
    left, comps = set(range(60)), []
    while left:
        front = {left.pop()}
        comp = set(front)
        while front:
            front = {j for j in left if any(100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i in front)}
            left -= front
            comp |= front
        comps.append(comp)
    want = {i: min(c) for c in comps for i in c}
    assert {r["id"]: r["cid"] for r in jaccard.classes(table(spark, rows), 2, 85).collect()} == want


def test_decontaminate_removes(spark):
    item = " ".join(f"B{i}" for i in range(12))
    docs = table(spark, [(1, f"Start, {item}! end.", "en"), (2, "clean text", "en"), (3, None, "en")])
    bench = spark.createDataFrame([(9, item, "x"), (8, "two words", "x")], BENCH)
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="span").collect()}
    assert spans == {1: "Start, end.", 2: "clean text", 3: None}
    for most in (0, 1, 2):  # in parts by hash
        few = {r["doc_id"]: r["n_hit"] for r in decontaminate.judge(docs, bench, max_broadcast=most).collect()}
        assert few == {1: 12, 2: 0, 3: 0}


def test_embeddings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 16 * 8 * 8)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(9, 8))
    v = [(i, [float(x) for x in centre[i % 9] * rng.uniform(0.5, 3) + rng.normal(size=8) * 0.25]) for i in range(150)]
    v += [(150, v[3][1]), (151, None), (152, []), (153, [0.0] * 8), (154, [1.0, float("nan")] + [0.0] * 6), (155, [1.0, 2.0]), (156, [2.0, 4.0]), (157, [1.0, None] + [0.0] * 6)]
    got = {r["vec_id"]: r for r in embeddings.classes(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()}
    ok = {i: np.array(x) / np.linalg.norm(x) for i, x in v if x and None not in x and np.isfinite(x).all() and any(x)}
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9} for i in ok}
    for i, _ in v:
        comp, front = {i}, {i}
        while front:
            front = set().union(*(links.get(j, set()) for j in front)) - comp
            comp |= front
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(comp), min(comp) == i)
    assert embeddings.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (101, 100)] + [(500, 600 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 500: 500} | {600 + i: 500 for i in range(50)}


def test_plan_uses_all_lengths():
    rng = random.Random(0)
    for most in (16, 64, 1024):
        histogram = {k: rng.randint(0, 9) for k in range(1, most + 1) if rng.random() < 0.3}
        patterns = packing.plan(histogram, most)
        used = {}
        for parts, n in patterns:
            assert n > 0 and sum(parts) <= most
            for p in parts:
                used[p] = used.get(p, 0) + n
        assert used == {k: v for k, v in histogram.items() if v}
    assert packing.plan({}, 8) == [] and sum(n for _, n in packing.plan({3: 4, 5: 2, 2: 2}, 8)) == 4


def test_ids_are_those_of_the_json_file():
    from tokenizers import Tokenizer

    t, plain = packing.tokenizer(), Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    bits = ["<|endoftext|>", "<|endo", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "é", "e\u0301", "ß", "中", "한", "ก", "😀", "\u200d", "\x00", "\x7f", "'s", "'ll", "12", "½", "_", "--", "word", "Word", " the", "ЁЖ"]
    texts = ["", "<|endoftext|> x", "a<|endoftext|>", "😀 a" * 50, " " * 3000, "a" * 2000]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    assert all(t.ids(x) == plain.encode(x, add_special_tokens=False).ids for x in texts)
    assert t.ids("<|endoftext|> x")[0] == 50256
    t.fast = None  # texts that the other library gives up on
    assert all(t.ids(x) == plain.encode(x, add_special_tokens=False).ids for x in texts[:50])
    packing._LOADED.clear()


def test_copies_share_a_shard(spark, tmp_path):
    """Groups of equal texts of up to a leaf stay whole, and sizes are near equal all the same; a larger group is cut."""
    rng = random.Random(8)
    rows = []
    for g in range(197):
        rows += [(len(rows) + i, f"text {g} " * rng.randint(20, 500), "en") for i in range(rng.randint(1, 8)) for _ in [rng.seed(g)]]
    leaf = sum(len(t) + 1 for _, t, _ in rows) / 16
    rows += [(10_000 + i, "x" * int(leaf / 4), "en") for i in range(3)]
    got = sharding.assign(table(spark, rows), 16).collect()
    size = np.bincount([r["shard"] for r in got], [r["size"] for r in got])
    homes = {}
    for r in got:
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in homes.values()) and len(size) == 16
    group = max(sum(r["size"] for r in got if (r["text_crc32"], r["size"]) == k) for k in homes)
    assert size.max() - size.min() <= 2 * group
    rows = [(i, f"text {i} " * (i % 17 + 1), "en") for i in range(400)] + [(1000 + i, "copy of one " * 9, "en") for i in range(3000)]
    got = sharding.assign(table(spark, rows), 4).collect()
    size = np.bincount([r["shard"] for r in got], [r["size"] for r in got])
    assert size.max() - size.min() <= 0.02 * size.sum() and len(size) == 4
    docs = table(spark, rows[:40]).withColumn("slot", F.lit(5)).withColumnRenamed("size", "shard")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 40 and {"own_shard", "own_slot", "shard", "slot", "rid"} <= set(back.columns)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(i, t) for i, t, _ in rows[:40]}


def test_weighted_medians_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice([0, 5, 2**62, rng.randrange(2**63)]), rng.randint(1, 9)) for n in (1, 2, 3) for _ in range(200)]
    goals = {1: 0, 2: 500, 3: 10**9, 4: 7}
    got = sharding._select(spark.createDataFrame(rows, "node int, key long, weight long"), goals)
    want = {}
    for n in (1, 2, 3):
        run = 0
        keys = sorted({k for m, k, _ in rows if m == n})
        for k in keys:
            w = sum(x for m, j, x in rows if m == n and j == k)
            want[n] = (k, run, w)
            run += w
            if run > goals[n]:
                break
    assert got == want


def test_urls_odd(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM?x"), (4, "x://net/es/1"), (5, "x://h.org"), (None, "x://h.org//a///b"), (5, "x://h.org")]
    rows += [(10 + i, f"https://mix.net/{'es' if i % 2 else 'zz'}/p{i}") for i in range(60)]
    got = urls.report(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["host"], by[1]["path"], by[2]["host"], by[3]["host"], by[3]["path"]) == ("", "", "", "a.example.com", "")
    assert by[4]["rule"] == "net/es/" and by[4]["verdict"] == "block" and by[3]["rule"] is None
    assert {r["template"] for r in got if r["host"] == "mix.net"} == {"/es/{p#}", "/zz/{p#}"}
    assert urls.report(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_reject_by_purity(spark):
    rules = (("block", "h.org", "/bad/1"), ("allow", "h.org", "/good/1"))
    rows = [(i, f"x://h.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(1, 400)]
    got = {r["page_id"]: r["verdict"] for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(1, 400)}


def test_subwords_catch_misspellings():
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(300):
        w = rng.choices(clean, k=30)
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(["dreadfulness", "abominable"])
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    score = toxicity.Scorer(toxicity.Trainer(texts, labels, 8).fit(5, 2000))
    assert score(" ".join(clean[:30] + ["abominabel", "dreadfulnes"])) > 0.5 > score(" ".join(clean[:30]))


def test_toxicity_score_is_the_softmax_of_the_most_toxic_window():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["calm", "quiet", "stone", "river", "vile", "Foul"][: 4 + 2 * (i % 2)], k=rng.randint(1, 9))) for i in range(80)]
    trainer = toxicity.Trainer(texts, [i % 2 for i in range(80)], 3)
    score = toxicity.Scorer(trainer.fit(3, 200))
    for text in [*texts[:20], "unseen words only", "vile"]:
        words = [np.mean([trainer.emb[f] for f in toxicity.features(w)], 0) for w in text.lower().split()]
        runs = [np.mean(words[i : i + 3], 0) for i in range(max(1, len(words) - 2))]
        z = [r @ trainer.out + trainer.bias for r in runs]
        assert abs(score(text) - max(np.exp(x[1]) / np.exp(x).sum() for x in z)) < 1e-4
    assert score("") == score(None) == score(" ,. ") == 0.0


def test_backoff():
    model = langid.Model(["a", "b"], {"known": 0}, {"<x": 0, "y": 1}, np.log([[0.9, 0.1]]), np.log([[0.2, 0.8], [0.6, 0.4]]))
    score = langid.Scorer(model)
    assert score("known")[0] == "a" and score("xz")[0] == "b" and score("zy")[0] == "a"
    assert score("123 ½") == ("und", 0.0) and score(None) == ("und", 0.0)


def test_filters_keep_columns(spark, odd):
    docs = table(spark, [(i, "the quick brown fox " * 3 if i % 2 else "der schnelle braune fuchs " * 3, "en" if i % 2 else "de") for i in range(60)] + [(99, "123", "en")])
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 60
    assert lines.dedup(odd).columns == odd.columns and jaccard.one_of_each(odd).columns == odd.columns
    assert F.col is not None


def test_passages_over_wide_gaps():
    hashes = substrings.WordHashes()
    told = lambda words: (substrings.sequence(" ".join(words), 5, hashes) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    w = [f"w{i}" for i in range(200)]
    inserted = substrings.passages(told(w[:49] + w[150:158] + w[49:98]), told(w[:98]), 5, 50, 0.8)
    assert inserted == [(0, 102, 0, 94)]
    swapped = substrings.passages(told(w[:90]), told(w[45:90] + w[:45]), 5, 50, 0.8)
    assert swapped == [(0, 86, 0, 86)]
    assert substrings.passages(told(w[:60] + w[100:130]), told(w[:60] + w[140:190]), 5, 50, 0.8) == [(0, 56, 0, 56)]


def test_passages_around_a_common_line(spark, tmp_path):
    """Pairs of rows share a passage around a line that all rows have, in another order on the later side."""
    rng = random.Random(11)
    line = [f"line{i}" for i in range(24)]
    word = lambda k: [f"{rng.choice('abcdefgh')}{rng.randrange(10**9)}" for _ in range(k)]
    shared = [(word(16), word(16)) for _ in range(150)]
    text = lambda i: " ".join(word(30) + shared[i][0] + line + shared[i][1] + word(30))
    later = list(range(150))
    rng.shuffle(later)
    rows = [(i, text(i)) for i in range(150)] + [(1000 + i, text(i)) for i in later]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    got = substrings.report(spark.read.parquet(str(tmp_path / "docs"))).collect()
    found = {frozenset((r["doc_id"] % 1000, r["first_doc_id"] % 1000)) for r in got}
    assert found == {frozenset((i,)) for i in range(150)}


def test_language_scores_by_brute_force(spark):
    """Fit and score against counts and sums written out plainly, on a tiny corpus."""
    rng = random.Random(5)
    stock = {"x": ["aab", "abba", "baab", "bab"], "y": ["cdd", "dccd", "bab", "cdc"]}
    rows = [(i, " ".join(rng.choices(stock[lang], k=6)), lang) for i in range(40) for lang in [rng.choice("xy")]]
    rows += [(100, "Rare abba", "x"), (101, "dccq aabz", None), (102, "!!", "x")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.report(table(spark, rows)).collect()}
    words, parts = {"x": {}, "y": {}}, {"x": {}, "y": {}}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            for w in re.findall(r"[a-z]+", text.lower()):
                words[lang][w] = words[lang].get(w, 0) + 1
                for n in range(1, 6):
                    for at in range(len(w) + 3 - n):
                        g = f"<{w}>"[at : at + n]
                        parts[lang][g] = parts[lang].get(g, 0) + 1

    def logs(counts):
        kept = {t for c in counts.values() for t in c if sum(d.get(t, 0) for d in counts.values()) > 1}
        total = {k: sum(c.get(t, 0) for t in kept) + 0.5 * len(kept) + 1 for k, c in counts.items()}
        return {t: {k: np.log((counts[k].get(t, 0) + 0.5) / total[k]) for k in counts} for t in kept}

    known, grams = logs(words), logs(parts)
    for i, text, _ in rows:
        found = re.findall(r"[a-z]+", text.lower())
        if not found:
            assert got[i] == ("und", 0.0)
            continue
        total = {"x": 0.0, "y": 0.0}
        for w in found:
            hit = [known[w]] if w in known else next((h for n in (5, 4, 3, 2, 1) if (h := [grams[g] for at in range(len(w) + 3 - n) if (g := f"<{w}>"[at : at + n]) in grams])), [])
            for k in total:
                total[k] += np.mean([h[k] for h in hit]) if hit else 0.0
        best = max(sorted(total), key=total.get)
        gap = (min(total.values()) - max(total.values())) * min(1, 10 / len(found))
        assert got[i][0] == best and abs(got[i][1] - 1 / (1 + np.exp(gap))) < 1e-4


def words_of(rng, k):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(k)]


def passage_pairs(spark, path, rows):
    """Pairs of rows that share a passage, read from one file in order of ids."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id").write.parquet(path)
    return {(r["doc_id"], r["first_doc_id"]) for r in substrings.report(spark.read.parquet(path)).collect()}


def test_nested_quotes(spark, tmp_path):
    """Half, other half, whole, and again: the whole passages find each other."""
    rng = random.Random(1)
    rows = []
    for _ in range(100):
        a, b = words_of(rng, 45), words_of(rng, 45)
        rows += [(len(rows) + j, " ".join(words_of(rng, 30) + x + words_of(rng, 30))) for j, x in enumerate((a, b, a + b, a, b, a + b))]
    found = passage_pairs(spark, str(tmp_path / "docs"), rows)
    assert all((i + 5, i + 2) in found for i in range(0, 600, 6))


def test_recall_of_overlapping_and_edited_passages(spark, tmp_path):
    rng = random.Random(6)
    rows, need = [], set()
    for _ in range(60):
        s = [words_of(rng, 20) for _ in range(6)]
        spans = [(0, 2), (2, 4), (1, 3), (4, 6), (3, 5), (0, 6), (0, 3), (3, 6), (0, 6)]
        rng.shuffle(spans)
        for j, (a, b) in enumerate(spans):
            need |= {(len(rows), len(rows) - j + i) for i in range(j) if min(b, spans[i][1]) - max(a, spans[i][0]) >= 3}
            rows.append((len(rows), " ".join(words_of(rng, rng.randint(10, 60)) + sum(s[a:b], []) + words_of(rng, rng.randint(10, 60)))))
    found = passage_pairs(spark, str(tmp_path / "quotes"), rows)
    assert len(need & found) >= 0.97 * len(need) > 100

    rows, need = [], set()
    for size in (55, 80, 200):
        for edits in (1, 2, 4):
            for _ in range(60):
                x = words_of(rng, size)
                y = list(x)
                for at in rng.sample(range(size), edits):
                    y[at] = "edited"
                a, b = ({tuple(w[i : i + 5]) for i in range(size - 4)} for w in (x, y))
                if len(a & b) >= 0.8 * len(a | b):
                    need.add((len(rows) + 1, len(rows)))
                rows += [(len(rows) + i, " ".join(words_of(rng, 40) + w + words_of(rng, 40))) for i, w in enumerate((x, y))]
    found = passage_pairs(spark, str(tmp_path / "edits"), rows)
    assert len(need & found) >= 0.95 * len(need) > 100


def test_windows_of_a_very_long_text():
    h = np.random.default_rng(0).integers(0, 2**63, 2**24 + 1000, dtype=np.uint64) * np.uint64(2)
    a, c, b = substrings.windows(h, np.array([0]), np.array([len(h)]), 2**23)
    assert (a[0], c[0], b[0]) == (0, int(h.argmin()), len(h))
    assert all(x <= y < z and y == x + int(h[x:z].argmin()) for x, y, z in zip(a, c, b, strict=True))


def grown(rows, tpl="", depth=0, share=0.02, least=5):
    """The template tree written out plainly: rid -> template, of rows (rid, segments, bad, good)."""
    out = {r[0]: tpl for r in rows if len(r[1]) <= depth}
    rows = [r for r in rows if len(r[1]) > depth]
    if len(rows) < least:
        return out | {r[0]: tpl + "/*" * (len(r[1]) - depth) for r in rows}

    def frequent(part):
        count = {}
        for r in rows:
            n, bad, good = count.get(part(r), (0, 0, 0))
            count[part(r)] = (n + 1, bad + r[2], good + r[3])
        return {k: v for k, v in count.items() if v[0] >= least and v[0] >= share * len(rows)}

    def differ(x, y):
        for i in (1, 2):
            p = (x[i] + y[i]) / (x[0] + y[0])
            if abs(x[i] / x[0] - y[i] / y[0]) > urls.Z * math.sqrt(p * (1 - p) * (1 / x[0] + 1 / y[0])):
                return True
        return False

    literal, branches, before = frequent(lambda r: r[1][depth]), [], None
    for seg in sorted(literal, key=lambda k: (literal[k][1] / literal[k][0], literal[k][2] / literal[k][0], k)):
        if before is None or differ(literal[seg], literal[before]):
            branches.append([])
        branches[-1].append(seg)
        before = seg
    names = {seg: "|".join(sorted(b)) for b in branches for seg in b}
    shapes = frequent(lambda r: re.sub("[0-9]+", "#", r[1][depth]))
    nodes = {}
    for r in rows:
        shape = re.sub("[0-9]+", "#", r[1][depth])
        nodes.setdefault(names.get(r[1][depth]) or (f"{{{shape}}}" if shape in shapes else "*"), []).append(r)
    for token, mine in nodes.items():
        out |= grown(mine, f"{tpl}/{token}", depth + 1, share, least)
    return out


def test_template_tree_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        segs = [rng.choice(["bad", "good", "mixed", "worse"]), rng.choice(["a", "b", f"p{i}", f"q{i}x{i}", "rare" + "z" * rng.randint(0, 60)])]
        segs += [rng.choice(["x", "y", str(i)]) for _ in range(rng.randint(0, 3))]
        bad = int(segs[0] in ("bad", "worse") and rng.random() < 0.7)
        rows.append((i, segs, bad, int(not bad and rng.random() < 0.4)))
    deep = ["d"] * 18
    rows += [(1000 + i, [*deep, "left" if i % 2 else "right", str(i)], i % 2, 1 - i % 2) for i in range(40)]
    table = spark.createDataFrame([(i, "h", "/" + "/".join(s), b, g) for i, s, b, g in rows], "rid long, host string, path string, bad long, good long")
    got = {r["rid"]: r["tpl"] for r in urls.templates(table).collect()}
    assert got == grown(rows)
    assert {got[1000 + i].split("/")[19] for i in range(40)} == {"left", "right"}


def test_decontamination_of_long_texts_and_large_suites(spark):
    """Ten lengths of windows at once, stretches against plain loops, and every way of sending the set."""
    rng = random.Random(11)
    some = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(some, k=k))) for i, k in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 40])]
    texts = [" ".join(rng.choices([*some, *(f"z{i}" for i in range(400))], k=k)) for k in (0, 1, 63, 64, 65, 73, 74, 128, 700)]
    texts += [f"{t} {items[7][1]} {t}" for t in texts[:5]] + [items[8][1], None]
    grams = {}
    for i, t in items:
        w = t.split()
        for at in range(max(1, len(w) - 9)):
            grams.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    want = []
    for n, t in enumerate(texts):
        w = (t or "").split()
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for at in range(len(w) - k + 1):
                if who := grams.get(tuple(w[at : at + k])):
                    hit |= set(range(at, at + k))
                    found |= who
        want.append((n, len(w), len(hit), sorted(found)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 2, 1, 0):
        got = decontaminate.judge(docs, bench, max_broadcast=most).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted(map(tuple, got)) == want


def test_decontamination_takes_time_in_proportion(spark):
    """Ten lengths of windows over one text of 400,000 words: seconds, where each word carrying its text would take hours."""
    import time

    items = [(k, " ".join(f"q{k}x{i}" for i in range(k))) for k in range(1, 11)]
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 5003}" for i in range(399_990)) + " " + items[9][1])], "doc_id long, text string")
    began = time.time()
    got = decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string")).first()
    assert (got["n_words"], got["n_hit"], got["n_items"]) == (400_000, 10, 1)
    assert time.time() - began < 120


def test_deep_templates_by_brute_force(spark):
    """Chains of many depths, leaves along a trap, branches at its end, digits on and off the path, equal and empty paths."""
    rng = random.Random(7)
    hosts = {
        "trap": [["a", "b"] * (i // 2) + ["page.html"] for i in range(60)],
        "chain": [["x"] * i for i in range(40)] + [[]] * 3,
        "fork": [["t", "t", "t", rng.choice(["left", "right"]), str(i)] for i in range(40)],
        "digits": [["n1", "n2", f"n{i}", "n4"] if i % 4 else ["n1", "n2", "n3", "n4", "n5", f"m{i}"] for i in range(50)],
        "few": [["q"] * i for i in range(3)],
    }
    rows = {h: [(1_000 * k + i, s, int(rng.random() < 0.2), 0) for i, s in enumerate(mine)] for k, (h, mine) in enumerate(hosts.items())}
    data = [(i, h, "/" + "//".join(s) + "/", b, g) for h, mine in rows.items() for i, s, b, g in mine]
    table = spark.createDataFrame(data, "rid long, host string, path string, bad long, good long")
    got = {r["rid"]: r["tpl"] for r in urls.templates(table, 0.1, 4).collect()}
    assert got == {k: v for mine in rows.values() for k, v in grown(mine, share=0.1, least=4).items()}


def test_a_path_of_a_thousand_segments(spark):
    import time

    path = "/" + "/".join(f"s{i}" for i in range(1_000))
    pages = spark.createDataFrame([(i, f"http://h.org{path}", 1, "x") for i in range(6)], "page_id long, url string, path int, host string")
    began = time.time()
    got = urls.verdicts(pages).collect()
    assert {r["template"] for r in got} == {path} and len(got) == 6
    assert time.time() - began < 60


def test_embeddings_with_odd_ids_and_columns(spark):
    """Null and repeated ids, vectors of several lengths, equal rows, and columns named as the operator's own."""
    v = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [1.0, 0.1, 0.0], "d": [1.0, 0.0]}
    rows = [(1, v["a"]), (1, v["b"]), (None, v["c"]), (2, v["a"]), (2, v["a"]), (3, v["d"]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [])]
    names = "vec_id long, embedding array<double>, rid long, v string, h int, fit boolean, n long, label int"
    df = spark.createDataFrame([(i, x, 0, "x", 1, True, 9, None) for i, x in rows], names)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.classes(df).collect())
    # The three equal vectors and the one near them are one class of four; of two rows with id 1 one belongs to it.
    assert got == sorted(
        [("1", 3, 1, True), ("1", 0, 1, True), ("None", 3, 1, False), ("2", 3, 1, False), ("2", 3, 1, False), ("3", 0, 3, True)] + [(str(i), 0, i, True) for i in range(4, 9)]
    )


def test_urls_beside_columns_of_the_same_names(spark):
    rows = [(i, f"http://h.org/{'a' if i % 2 else 'b'}/{i}", "x", "y", 1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, tpl string, rid long, l int")
    plain = sorted(map(tuple, urls.verdicts(df.select("page_id", "url")).collect()))
    assert sorted(map(tuple, urls.verdicts(df).collect())) == plain and len(plain) == 20


def test_toxicity_words_are_hashed_at_once():
    weights = np.random.default_rng(3).normal(size=toxicity.BUCKETS).astype(np.float32)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcXé漢😀_-9", k=rng.randint(1, 12))) for _ in range(20_000)]
    began = time.process_time()
    want = np.array([weights[toxicity.features(w)].mean() for w in words])
    plain, began = time.process_time() - began, time.process_time()
    got = toxicity.word_means(words, weights)
    assert time.process_time() - began < plain / 3
    assert abs(got - want).max() < 1e-6
    model = toxicity.Model(weights, 4, 0.1)
    assert toxicity.Scorer(model).scores(["a bé", None, "", "漢 x"]) == [toxicity.Scorer(model)(t) for t in ("a bé", None, "", "漢 x")]
