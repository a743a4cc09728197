"""The text operators' models and fingerprints against plain versions, value by value; and columns with names that clash."""

import bisect
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rastrum.llm import bpe, exact_dedup, langid, licenses, line_dedup, mixing, parsing, quality, simhash, url_filter

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


# 3: one phrase after another, in Python's integers
def mix(x):
    x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & M64
    return x ^ (x >> 29)


def lowest(x, none):
    return (x & -x).bit_length() - 1 if x else none


def next_level(names):
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x ^ ((n - 1) * 0xD6E8FEB86659FD93 & M64) for x, n in runs]
    label = []
    for i, x in enumerate(names):
        place = lowest(x ^ (names[i - 1] if i else ~x & M64), 64)
        label.append((2 * place + (x >> min(place, 63) & 1)) & 255)
    for _ in range(3):
        new = []
        for i, x in enumerate(label):
            place = lowest(x ^ (label[i - 1] if i else x ^ 1), 8)
            new.append(2 * place + (x >> min(place, 7) & 1))
        label = new
    starts = [i for i in range(len(names)) if i == 0 or label[i] > label[i - 1] and (i == len(names) - 1 or label[i] > label[i + 1])]
    out = []
    for a, b in zip(starts, [*starts[1:], len(names)]):
        out.append(mix(sum(mix((names[j] + (j - a) * 0xA0761D6478BD642F) & M64) for j in range(a, b)) & M64))
    return out


def plain_print(text):
    least, names = {}, [ord(c) + 1 for c in text]
    for level in (1, 2, 3):
        names = next_level(names) if names else []
        if level > 1 or len(text) < 64:
            for x in names:
                h = mix(x ^ (level * 0x632BE59BD9B4E019 & M64))
                least[h & 127] = min(least.get(h & 127, M64), h >> 7)
    return [max(1, mix(least[b]) >> 48) if b in least else 0 for b in range(128)]


def test_fingerprints_by_hand():
    r = random.Random(11)
    texts = ["", "a", "aaaa", "ab" * 40, "été 😀 naïve"] + ["".join(r.choices(r.choice(["ab", "abcde fgh", "aé中😀 "]), k=r.choice([1, 3, 20, 63, 64, 500]))) for _ in range(60)]
    assert parsing.fingerprints(texts).tolist() == [plain_print(t) for t in texts]
    a, b = plain_print(texts[8]), plain_print(texts[9])
    some = [(x, y) for x, y in zip(a, b) if x or y]
    want = sum(x == y for x, y in some) / len(some) if some else 1.0
    assert parsing.likeness(np.array([a], np.uint16), np.array([b], np.uint16))[0] == want


# 2
def plain_ngrams(text):
    out, low = [" "], text.lower()
    for i, c in enumerate(low):
        if unicodedata.category(c)[0] == "L":
            out.append(c)
        elif i == 0 or unicodedata.category(low[i - 1])[0] == "L":
            out.append(" ")
    codes = [ord(c) for c in [*out, " "]]
    found = Counter()
    for i in range(len(codes)):
        h = codes[i] * 0x9E3779B1 & M32
        found[h >> 16] += 1
        for n in (1, 2):
            if i + n < len(codes):
                h = ((h ^ h >> 15) * 0x85EBCA77 + codes[i + n] * 0xC2B2AE3D) & M32
                found[((h ^ h >> 13) * 0x27D4EB2F & M32) >> 16] += 1
    return found


TEXTS = [("the quick brown fox and the dog", "en"), ("der schnelle braune Fuchs und der Hund", "de"), ("le renard brun et le chien, été", "fr"), ("a dog is here; the end.", "en"), ("ein Hund ist hier", "de"), ("un chien est ici 12", "fr")] * 2


def test_ngrams_by_hand():
    for text, _ in TEXTS + [("中文 abc中文", ""), ("a", ""), ("1a2b  c", "")]:
        at, counts = langid.ngram_counts(text)
        assert dict(zip(at.tolist(), counts.tolist())) == plain_ngrams(text)


def test_language_model_by_hand():
    """Follow-the-regularised-leader, one coordinate after another."""
    langs, rows = ["de", "en", "fr"], [(plain_ngrams(t), y) for t, y in TEXTS]
    df = Counter(b for g, _ in rows for b in g)
    idf = np.array([math.log((1 + len(rows)) / (1 + df.get(b, 0))) + 1 for b in range(langid.BUCKETS)])
    given = [(np.array(sorted(g)), np.array([float(g[b]) for b in sorted(g)]), langs.index(y)) for g, y in rows]
    model = langid.fit(langs, idf, given)

    def vector(g):
        x = {b: (1 + math.log(n)) * idf[b] for b, n in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    z, n = {}, {}

    def weight(k):
        l1 = 0 if k[0] == langid.BUCKETS else langid.L1
        if abs(z.get(k, 0)) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)

    def odds(x, t=1.0):
        s = [sum(v * weight((b, c)) for b, v in x.items()) / t for c in range(3)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    for _ in range(langid.EPOCHS):
        for g, y in rows:
            x = vector(g) | {langid.BUCKETS: 1.0}
            p = odds(x)
            for c in range(3):
                step = p[c] - (langs[c] == y)
                for b, v in x.items():
                    k, gr, w = (b, c), v * step, weight((b, c))
                    z[k] = z.get(k, 0) + gr - (math.sqrt(n.get(k, 0) + gr * gr) - math.sqrt(n.get(k, 0))) / langid.ALPHA * w
                    n[k] = n.get(k, 0) + gr * gr
        # the weights of an epoch are seen by the next one
    for text in ("the dog", "der Hund", "le chien 5", "x"):
        p = odds(vector(plain_ngrams(text)) | {langid.BUCKETS: 1.0}, model.temperature)
        lang, score = model.predict(text)
        assert abs(score - max(p)) < 1e-9 and lang == langs[p.index(max(p))]
    assert (model.weights == 0).mean() > 0.9  # elastic net keeps it sparse


# 6
def test_quality_scores_by_hand():
    rng = np.random.default_rng(2)
    x = rng.random((400, 4))
    m = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 400) > 0.8).astype(float))
    for row, got in zip(x[:50], m.score(x[:50])):
        z = m.intercept + sum(t[bisect.bisect_right(m.edges[k].tolist(), row[k])] for k, t in enumerate(m.tables))
        z += sum(g[bisect.bisect_right(m.grid_edges[i].tolist(), row[i]), bisect.bisect_right(m.grid_edges[j].tolist(), row[j])] for (i, j), g in zip(m.pairs, m.grids))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-12
    assert m.pairs and ((m.score(x) >= 0.5) == (x[:, 0] + x[:, 1] * x[:, 2] > 0.8)).mean() > 0.9


def test_quality_trees_by_hand():
    """The first cut is the best of all, the second the best that is left."""
    r = random.Random(3)
    for _ in range(100):
        g, h = [r.gauss(0, 5) for _ in range(9)], [r.random() * 9 for _ in range(9)]
        value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + quality.SMOOTH)
        cuts = [0, 9]
        for _ in range(2):
            best = max(((value(a, s) + value(s, b) - value(a, b), -s) for a, b in zip(cuts, cuts[1:]) for s in range(a + 1, b)), default=(0, 0))
            if best[0] > 1e-9:
                cuts = sorted([*cuts, -best[1]])
        want = [sum(g[a:b]) / (sum(h[a:b]) + quality.SMOOTH) for a, b in zip(cuts, cuts[1:]) for _ in range(a, b)]
        assert np.allclose(quality._tree(np.array(g), np.array(h), 3), want)


# Columns with names that operators use themselves
NAMES = (
    "row lh lh2 g me key k line fp component_id size source_size target copies copy hash limit seed base of more0 lang_pred score host path rule verdict best met removed hit own n b _part _map _at may "
    "id chars norm full carried keep times part ends late soon first prefix t h m0 pos a where_ tries windows words license body bands value contained large draw repeated tokens_ root node kept keep_id group_size"
).split()


@pytest.fixture(scope="module")
def clashing(docs_of):
    docs = docs_of([(i, f"some words of text {i % 5}\nand the same second line for all\nthe dog and the fox {'again ' * (i % 3)}", "en" if i % 2 else "de", "ab"[i % 2]) for i in range(30)] + [(30, None), (31, "")])
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in NAMES])


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:4]], ids=lambda s: s[0])
def test_stages_keep_clashing_columns(spark, clashing, stage):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    out, want = stage[1](spark, clashing, ""), stage[1](spark, plain, "")
    assert out.columns == clashing.columns
    got = [r.asDict() for r in out.collect()]
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in got for c in NAMES)
    pick = lambda r: (r["doc_id"], r["text"], r["n_chars"])
    assert Counter(map(pick, got)) == Counter(map(pick, (r.asDict() for r in want.collect())))


def test_operators_bear_clashing_columns(spark, clashing):
    import public_tokenizers as P

    names = ["doc_id", *NAMES]
    n = clashing.count()
    out = bpe.encode(clashing, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, names, ["n_tokens"], chunk=20, overlap=8)
    assert out.columns == [*names, "n_tokens"] and out.where("key = concat('key:', doc_id)").count() == n
    with pytest.raises(ValueError):
        bpe.encode(clashing.withColumnRenamed("g", "IDS"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["IDS"], ["ids"])
    for rows in (
        langid.predict(clashing, langid.train(clashing.select(F.col("doc_id").alias("id"), "text", "lang"))),
        quality.score(clashing, quality.Model()),
        simhash.simhash_components(clashing, names),
        mixing.with_copies(clashing),
        url_filter.judge_urls(clashing.withColumn("url", F.lit("http://a.net/x")), list(url_filter.RULES)),
    ):
        assert rows.where("row.key = concat('key:', row.doc_id)").count() == n
    assert exact_dedup.exact_dedup(clashing).count() == n and parsing.compare_with_edits(clashing).count() == n
    assert licenses.find_licenses(clashing, licenses.known_templates(spark)).count() == 0
    assert {r.doc_id for r in line_dedup.removed_lines(clashing).collect()} >= set(range(1, 30))


def test_empty_pipeline(spark, docs_of):
    empty = docs_of([(1, "x", "en", "a")]).where("doc_id < 0")
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, "")
        assert empty.count() == 0


def test_pipeline_on_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    counts = []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, "").cache()
        counts.append(docs.count())
    assert counts[0] == 8 and counts[2] <= counts[1] <= counts[0] and docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from rastrum.llm.common import shared_folder

    lone = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(lone)
