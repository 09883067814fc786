"""The registered queries against SQL, and what must hold of the others, on the smallest tables."""

import math
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from tonewise.llm import oracles, queries
from tonewise.llm.common import saved


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(same_as_sql, name):
    same_as_sql(queries.queries()[name], oracles.oracle_sql()[name])


def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_url_rules(spark, sf):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op2_url_filters(spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = urls[r["page_id"]].split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), v, h + p) for v, h, p in rules if f".{host}".endswith(f".{h}") and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[2] if fit else None)
        assert r["verdict"] == (max(fit)[1] if fit else r["verdict"]) and r["verdict"] in ("allow", "block")


@pytest.mark.parametrize("query", [queries.op3_toxicity, queries.op9_language_id])
def test_scores_every_document(spark, sf, query):
    got = query(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents(spark, sf))
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op9_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op3_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.94
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in held)


def test_shards(spark, sf):
    docs = documents(spark, sf)
    got = queries.op4_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"], r["law"]) == (len(text) + 1, crc32(text), None, "bytes")
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(size) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    from tonewise.llm.packing import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    got = queries.op6_packing(spark, sf).collect()
    docs = documents(spark, sf)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for d, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for i, r in enumerate(sorted(pieces[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (i, at, crc32(ids[at : at + r["length"]].tobytes()))
            assert r["length"] == 1024 or i == 0
            at += r["length"]
        assert at == len(ids)
    for s in places.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 1024
    assert len(places) <= 1.05 * math.ceil(sum(r["length"] for r in got) / 1024) + 1


def test_repeated_passages(spark, sf):
    docs = {d: (t or "").encode().lower().split() for d, t in documents(spark, sf).items()}
    got = queries.op7_substring_dedup(spark, sf).collect()
    first, need = {}, defaultdict(set)
    for d in sorted(docs):
        for i in range(len(docs[d]) - 59):
            if first.setdefault(tuple(docs[d][i : i + 60]), d) != d:
                need[d].update(range(i, i + 60))
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        a, b = docs[r["doc_id"]][r["start_word"] : r["end_word"]], docs[r["first_doc_id"]][r["first_start_word"] : r["first_end_word"]]
        assert len(a) >= 50 and len(b) >= 50
    need = {d: s for d, s in need.items() if len(set(docs[d])) > 60}
    assert sum(len(s & found[d]) for d, s in need.items()) >= 0.9 * sum(map(len, need.values()))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(names), name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, sf).count() > 0


def pipeline_documents(spark, sf):
    """Documents in two languages with repeated and edited lines, near copies, benchmark passages and junk."""
    rng = random.Random(21)
    stock = {"en": [f"en{a}{b}" for a in "bcdfg" for b in "aeiou"], "de": [f"sch{a}{b}" for a in "klmnp" for b in "äöü"]}
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"].split()
    common = " ".join(rng.choices(stock["en"], k=9))
    rows = []
    for i in range(90):
        lang = "de" if i % 3 == 0 else "en"
        lines = [" ".join(rng.choices(stock[lang], k=rng.randint(8, 20))) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.insert(1, common if i % 2 else common[:-1] + "z")
        if i % 7 == 3 and rows:
            words = rows[-1][1].replace("\n", " \n ").split(" ")
            words[rng.randrange(len(words))] = "edited"
            lines = " ".join(words).replace(" \n ", "\n").split("\n") + ["x" if i % 2 else "yy"]
        if i % 11 == 0:
            lines.append(" ".join(item[:12]))
        rows.append((i, "\n".join(lines), lang))
    for i in range(200, 212, 2):  # long lines, each with a copy of one other word
        w = rng.choices(stock["en"], k=80)
        rows += [(i, " ".join(w), "en"), (i + 1, " ".join([*w[:30], "edited", *w[31:]]), "en")]
    rows += [(100, "12 34 !!", "en"), (101, None, None), (102, "", "en"), (103, rows[4][1], "en"), (104, rows[4][1], "en")]
    return spark.createDataFrame([(i, t, lang, f"s{i % 4}", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_by_brute_force(spark, sf):
    """Each stage against a plain version of it, on the stage's own input."""
    from tonewise.llm import langid, packing

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :] or a == b

    def languages(docs):
        score = langid.Scorer(langid.fit(frame))
        told = {i: score(t) for i, t in docs.items()}
        return {i: t for i, t in docs.items() if told[i][0] != "und" and told[i][1] >= 0.5}

    def distinct_lines(docs):
        seen, out = [], {}
        for i in sorted(docs):
            left = []
            for line in docs[i].split("\n"):
                gone = line.strip(" ") and any(s == line or min(len(s), len(line)) >= 20 and near(s, line) for s in seen)
                seen += [line] if line.strip(" ") else []
                left += [] if gone else [line]
            if any(x.strip(" ") for x in left):
                out[i] = "\n".join(left)
        return out

    def one_of_each(docs):
        sets = {}
        for i, t in docs.items():
            w = t.lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        left, out = sorted(docs), {}
        while left:
            front = [left.pop(0)]
            out[front[0]] = docs[front[0]]
            while front:
                a = front.pop()
                linked = [b for b in left if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
                left = [b for b in left if b not in linked]
                front += linked
        return out

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    def clean(docs):
        windows = set()
        for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
            w = words(r["text"])
            windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
        sizes = {len(x) for x in windows}
        return {i: t for i, t in docs.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}

    frame = pipeline_documents(spark, sf)
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (languages, distinct_lines, one_of_each, clean), strict=False):
        out = saved(stage(spark, frame, sf), "test")
        docs = {r["doc_id"]: r["text"] for r in frame.collect()}
        want = plain(docs)
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert got == want and 0 < len(got) < len(docs), name
        frame = out
    docs = {r["doc_id"]: r["text"] for r in frame.collect()}
    pieces, t, places = defaultdict(list), packing.tokenizer(), defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in docs.items():
        ids = np.array([*t.whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert sorted(pieces[i]) == [(0, 0, len(ids), crc32(ids.tobytes()))]
    assert set(pieces) == set(docs) and all(sum(n for _, n in s) <= 1024 and len({a for a, _ in s}) == len(s) for s in places.values())
