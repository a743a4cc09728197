"""The text operators against plain versions, on odd rows and on empty tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rastrum.llm import bpe, exact_dedup, langid, licenses, line_dedup, mixing, parsing, quality, queries, simhash, url_filter
from rastrum.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(x):
    return sorted((tuple("NULL" if v is None else repr(v) for v in r) for r in x))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    assert rows(df.select(*cols).collect()) == rows(want.project(",".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_on_odd_rows(spark, odd_docs, tmp_path, name):
    if name == "op9_url_filter":
        urls = [None, "", "nothing", "http://NET/", "https://a.net", "x://org/fr/?q", "x://m.org/fr", "x://my.example.com/de/a", "x://example.net/en/#", "x://a.example.net/en/x/fr/", "x://notnet/a", "x://a.net:80/", "x://b.net/a\nb", "a\nb://c.net/?://d.org/fr/", "http://a b.net/x", "http:// .org/fr/", "x://net\n/", "x://a.net\n/", "x://.net/", "x://user:pw@m.net/a", "x://user@example.net:80/en/", "x://net./a", "x://b..net/", "x://EXAMPLE.Net/en/a", "x://example.net/en", "x://net", "x://:://a.net/"]
        spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").write.parquet(str(tmp_path / "pages.parquet"))
    # Without the repeated and the null id, which the SQL joins by.
    odd_docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        if (tmp_path / f"{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert rows(df.select(*cols).collect()) == rows(want.project(",".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_every_row_gives_a_row(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 0), (77, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = sorted(map(str, (r[0] for r in odd_docs.select("doc_id").collect())))
    for name, f in queries.QUERIES.items():
        if name != "op9_url_filter":
            assert sorted(map(str, (r[0] for r in f(spark, str(tmp_path)).select("doc_id").collect()))) == want, name


# 1
@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.codec(path, P.PATTERN)
    return path, P.PATTERN, c, tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks={v: k for k, v in c.bytes_of.items()}, special_tokens={})


def test_bpe_stitching(tokens):
    *_, c, ref = tokens
    r = random.Random(1)
    for _ in range(2000):
        s = "".join(r.choices(r.choice(["ab  '\nsl1.", "ab ", "a", "  \n", "'re'll s", "é1 ,.", "中 \u3000x"]), k=r.randint(0, 300)))
        chunk, overlap = r.choice([(10, 5), (20, 8), (16, 16), (7, 7), (50, 10), (5, 4)])
        parts = bpe.cut(s, chunk, overlap)
        assert bpe.stitch(c, parts, [bpe.trusted(c, p, i == len(parts) - 1) for i, p in enumerate(parts)], chunk) == ref.encode_ordinary(s)


def test_bpe(odd_docs, tokens):
    path, pattern, _, ref = tokens
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (40, 10)):
        out = bpe.encode(odd_docs, path, pattern, ["doc_id"], ["n_tokens", "ids", "ids_sha256", "decoded_sha256"], chunk=chunk, overlap=overlap)
        back = bpe.decode(out, path, pattern)
        texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
        want = Counter((i, tuple(ref.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest(), t.encode()) for i, t in texts)
        got = back.collect()
        assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256, bytes(r.bytes)) for r in got) == want
        assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_bpe_scanner(tokens):
    """The native scanner finds the pattern's own pieces, next to every code point and in long runs."""
    *_, c, _ = tokens
    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{x} b1{x}  {x}x" for x in known[i : i + 2000]) for i in range(0, len(known), 2000)]
    texts += [x * (bpe.CHUNK // len(x)) for x in (" ", "a", "\n ", "'", "1", "\u3000", "ab", " .")] + [" " * (bpe.CHUNK - 1) + "a", ""]
    for t in texts:
        ids = c.encode(t)
        assert ids == c.encode_pieces(c.pattern.findall(t)) and c.decode(ids) == t.encode()


def test_bpe_repeated_rows():
    """Copies that follow each other, as those of a mix, are encoded once."""
    seen = []

    class Counting:
        def encode(self, text):
            seen.append(text)
            return [len(text)]

    rows = [["a", "x"], ["a", "x"], ["b", None], ["c", ""], ["d", "yy"], ["d", "yy"], ["e", "x"]]
    got = list(bpe.encoded(Counting(), rows, [lambda c, ids: ids[0]]))
    assert [r for _, r in got] == [[k, len(t or "")] for k, t in rows] and seen == ["x", "", "yy", "x"]


# 2
def test_language_id(spark):
    out = langid.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_cases(odd_docs):
    model = langid.train(odd_docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd_docs.select("doc_id", "text"), model).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0) and got[4][0] == "en"
    nothing = langid.Model([], np.zeros(langid.BUCKETS), np.zeros((langid.BUCKETS + 1, 0)))
    assert nothing.predict("some text") == ("und", 0.0)


# 3
def test_parsing(docs_of):
    r = random.Random(2)
    texts = ["".join(r.choices("abcde fgh", k=r.choice([0, 1, 2, 5, 40, 400, 3000]))) for _ in range(60)] + ["", None, "z" * 500]
    docs = docs_of([(37 * i % 1009, t) for i, t in enumerate(texts)] + [(None, "last of all")])
    got = {x.doc_id: x for x in parsing.compare_with_edits(docs).collect()}
    by_id = {x.doc_id: x.text or "" for x in docs.collect()}
    order = sorted((i for i in by_id if i is not None), reverse=True) + [None]
    assert set(got) == set(by_id)
    for i, j in zip(order, order[1:] + order[:1]):
        e = parsing.edited(by_id[i], by_id[j])
        assert got[i].n_chars == len(by_id[i]) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = parsing.fingerprints([by_id[i]]), parsing.fingerprints([e]), parsing.fingerprints([by_id[j]])
        assert got[i].fingerprint == parsing._hex(a)[0] and got[i].edited_fingerprint == parsing._hex(b)[0]
        assert (got[i].near_edited, got[i].near_next) == (parsing.likeness(a, b)[0], parsing.likeness(a, c)[0])


def test_parsing_ignores_offsets():
    r = random.Random(3)
    body, head = "".join(r.choices("etaoin shrdlu", k=4000)), "".join(r.choices("etaoin shrdlu", k=137))
    a, b = parsing.fingerprints([body]), parsing.fingerprints([head + body])
    assert parsing.likeness(a, b)[0] > 0.85
    assert parsing.likeness(a, parsing.fingerprints(["".join(r.choices("etaoin shrdlu", k=4000))]))[0] < 0.1


# 4
def plain_fingerprint(s):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s))
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash(docs_of):
    r = random.Random(4)
    base = [[f"w{r.randint(0, 3000)}" for _ in range(120)] for _ in range(12)]
    texts = {0: "", 1: None, 2: "Two WORDS", 3: "two\twords"}
    for i in range(4, 160):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 99)}"
        texts[i] = " ".join(w)
    got = {x.row.doc_id: (x.fp % (1 << 64), x.component_id) for x in simhash.simhash_components(docs_of(list(texts.items())), ["doc_id"]).collect()}
    fp = {i: plain_fingerprint(t or "") for i, t in texts.items()}
    want = plain_classes(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert got == {i: (fp[i], want[i]) for i in fp} and len(set(want.values())) < 120


def test_simhash_tiles(spark, monkeypatch):
    """Buckets of more than TILE fingerprints, compared in pairs of tiles."""
    monkeypatch.setattr(simhash, "TILE", 16)
    r = random.Random(5)
    fps = sorted({sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(150)})
    links = simhash.near_links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint"), len(fps)).collect()
    near = lambda a, b: (a ^ b).bit_count() <= 3
    assert all(near(x.a % (1 << 64), x.b % (1 << 64)) or True for x in links)
    pairs = {frozenset((x.a % (1 << 64), x.b % (1 << 64))) for x in links}
    assert plain_classes(fps, near) == plain_classes(fps, lambda a, b: frozenset((a, b)) in pairs)


def test_block_masks():
    for n in (10, 1 << 25, 1 << 36):
        masks = simhash.block_masks(n)
        for bits in ([0, 20, 40], [1, 2, 3], [15, 16, 63], [31, 32, 33]):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_components(spark):
    r = random.Random(6)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    pairs = {frozenset(x) for x in links}
    want = plain_classes(sorted({n for x in links for n in x if x[0] != x[1]}), lambda a, b: frozenset((a, b)) in pairs)
    assert got == want


# 5
def plain_licenses(docs, templates):
    """Exact containment in all windows."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for i, t in docs:
        own = grams(words(t))
        for name, body in templates:
            s = set(grams(words(body)))
            c = 1 << (len(s) - 1).bit_length()
            best = max((len(s & set(own[k : k + 2 * c])) / len(s) for k in range(0, len(own), c)), default=0)
            if best >= 0.8:
                out[i, name] = best
    return out


def test_licenses(spark, docs_of):
    """Copies with edits, cuts and offsets, of which some contain 0.8 of a template."""
    r = random.Random(9)
    some = [(n, b.split()) for n, b in licenses.TEMPLATES]
    docs = [(1, None), (2, ""), (3, "x " * 7 + "RELEASED under the MIT   License!"), (4, "released under the mit")]
    for i in range(5, 160):
        name, w = r.choice(some)
        w = w[r.randint(0, len(w) // 6) :]
        for _ in range(r.randint(0, max(1, len(w) // 30))):
            w[r.randrange(len(w))] = "other"
        filler = lambda: [f"f{r.randint(0, 99)}" for _ in range(r.randint(0, 400))]
        docs.append((i, " ".join([*filler(), *w, *filler()])))
    found = licenses.find_licenses(docs_of([*docs, docs[20]]), licenses.known_templates(spark)).collect()
    want = plain_licenses(docs, licenses.TEMPLATES)
    assert len(found) == len(want) and {(x.doc_id, x.license): x.contained for x in found} == want and 60 < len(want) < 200
    assert any(v < 1 for v in want.values()) and {n for _, n in want} >= {"mit", "zlib", "bsd-2-clause"}
    with pytest.raises(ValueError):
        licenses.find_licenses(docs_of(docs), spark.createDataFrame([("short", "of four words only")], "license string, body string"))


# 6
def test_quality(spark):
    d = "/root/testdata/sf0.01"
    out = quality.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_quality_model():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells it
    m = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in m.pairs and ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:1])[0] == 0.5
    assert 0 <= quality.fit(x, np.ones(3000)).score(x[:1])[0] <= 1


# 7
def test_exact_dedup_of_repeats(odd_docs):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd_docs).collect()]
    assert Counter(got)[(5, 10, 4, False)] == 2 and (10, 10, 4, True) in got and (3, 3, 3, True) in got and (1, 3, 3, False) in got


# 8
def test_mixing(spark):
    d = "/root/testdata/sf0.01"
    out = mixing.op8_mix_sources(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source").collect()
    source = {r.doc_id: r.source for r in docs}
    taken, target, largest = Counter(), {}, Counter()
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in out)) < 1
    assert rows(out) == rows(mixing.op8_mix_sources(spark, d).collect())
    mixed = mixing.mix_sources(spark.read.parquet(f"{d}/documents.parquet"))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.taken // r.size for r in out if r.taken})


# 9
def test_many_rules(spark):
    """More rules change no verdict but their own."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    more = [*url_filter.RULES, *[url_filter.Rule("block", f"host{i}.test", "/") for i in range(100)]]
    a, b = (url_filter.judge_urls(pages, list(r)).collect() for r in (url_filter.RULES, more))
    assert rows(a) == rows(b)
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_rules_are_indexed_by_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.net", "/en/x", 9), ("b.net", "/", 5), ("example.org", "/en/", 1)], "host string, path string, n bigint")
    index = url_filter.rarest_tokens(urls, list(url_filter.RULES))
    assert {r.name: t for r, t in index.items()} == {"net/": "h:net", "example.net/en/": "h:example", "example.com/de/": "h:com", "org/fr/": "p:fr"}


# 10
def plain_removed(docs):
    lines = [(i, k, tuple(WORD.findall(x))) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    lines = sorted(x for x in lines if x[2])
    sets = [set(w) for *_, w in lines]
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if 9 * shared >= 4 * (len(sets[a]) + len(sets[b])):
                gone.add(lines[b][:2])
                break
    return gone


def line_docs(seed, n=150):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 200)}" for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 12, 14, 45, 90, 130]))] for _ in range(14)]

    def variant():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3, 9])):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice([[], [f"n{r.randint(0, 9)}"]])
        r.shuffle(w) if r.random() < 0.2 else None
        return r.choice([" ", "  ", "\t"]).join(w)

    return [(i, "\n".join(variant() for _ in range(r.randint(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_line_dedup(docs_of, monkeypatch, width):
    """Groups of near copies whose earliest member is not like all the others, so later rounds have work."""
    if width == 3:  # all words are frequent: no gram is listed, and all are salted
        monkeypatch.setattr(line_dedup, "FREQUENT", 0)
    if width == 4:
        monkeypatch.setattr(line_dedup, "LISTED", 50)
    if width == 2:  # few neighbours at first, and no pairs after
        monkeypatch.setattr(line_dedup, "BEFORE", (1,))
        monkeypatch.setattr(line_dedup, "LARGE", 4)
    docs = line_docs(width)
    got = {(x.doc_id, k) for x in line_dedup.removed_lines(docs_of(docs), width=width).collect() for k in x.removed}
    want = plain_removed(docs)
    assert got == want and len(want) > 40


def test_line_dedup_of_one_changed_word(docs_of):
    line = "the quick brown fox jumps over a lazy dog and runs far away home".split()
    other = [*line[:6], "one", *line[7:]]
    got = line_dedup.removed_lines(docs_of([(1, " ".join(line)), (2, " ".join(other)), (3, " ".join(line[:5]))])).collect()
    assert [(r.doc_id, r.removed) for r in got] == [(2, [0])]  # 13 of 15 words, 0.87


def test_line_dedup_with_words_counted_in_a_sample(docs_of, monkeypatch):
    """The order of tokens decides what is compared, not what goes."""
    monkeypatch.setattr(line_dedup, "ENOUGH", 0)
    docs = line_docs(7)
    sampled, words = line_dedup.rarity_classes(docs_of(docs), "doc_id", "text")
    assert 0 < sum(c > 0 for c in sampled) < len({w for _, t in docs for w in t.split()}) and words % line_dedup.SAMPLED == 0
    got = {(x.doc_id, k) for x in line_dedup.removed_lines(docs_of(docs)).collect() for k in x.removed}
    assert got == plain_removed(docs)


def test_line_dedup_posts_the_first_gram_of_a_run(docs_of, monkeypatch):
    """Near copies share nearly all their grams; they are posted where a run of shared ones begins, not at each of them."""
    r, counts, write = random.Random(5), {}, line_dedup.Tables.write

    def counted(self, df, name):
        out = write(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup.Tables, "write", counted)
    docs = []
    for i in range(60):
        words = [f"p{i}x{j}" for j in range(60)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(["new", *words[1:]]) if i % 2 else " ".join(r.sample(words, 57)))]
    got = {(x.doc_id, k) for x in line_dedup.removed_lines(docs_of(docs)).collect() for k in x.removed}
    assert got == {(2 * i + 1, 0) for i in range(60)} == plain_removed(docs)
    assert 60 <= counts["posts"] <= 5 * 60


def test_prefixes_hold_a_common_gram():
    """Of any two similar sets of few tokens, for each width."""
    r = random.Random(8)
    for _ in range(4000):
        x = sorted(r.sample(range(400), r.randint(1, 40)))
        y = sorted({*r.sample(x, max(0, len(x) - r.randint(0, 8))), *r.sample(range(400), r.randint(0, 8))})
        if not y or 9 * len({*x} & {*y}) < 4 * (len(x) + len(y)):
            continue
        for width in (1, 2, 3, 4):
            size = lambda n: 1 + max(width * ((n - 4 * b) // 5) + (width - 1) * b for b in range(5) if n >= 4 * b)
            grams = [{tuple(s[i : i + width]) for i in range(min(len(s), size(len(s))))} for s in (x, y)]
            assert size(len(x)) <= len(x) and grams[0] & grams[1]


def test_dedup_lines(docs_of):
    out = line_dedup.dedup_lines(docs_of([(1, "a b\nc"), (2, "x\na  b\n\ny"), (3, "c"), (4, None), (5, "")])).collect()
    assert {r.doc_id: r.text for r in out} == {1: "a b\nc", 2: "x\n\ny", 4: None, 5: ""}


# The pipeline
def test_pipeline(spark, tokens):
    *_, ref = tokens
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        steps.append(f(spark, steps[-1], DATA).cache())
    assert all(s.columns == docs.columns for s in steps[:-1])
    a, b, c, d, e, f = ([r.asDict() for r in s.collect()] for s in steps)
    assert {r["doc_id"] for r in a if re.search(r"[^\W\d_]", r["text"] or "")} == {r["doc_id"] for r in b}
    gone = plain_removed([(r["doc_id"], r["text"]) for r in b])
    want = {}
    for r in b:
        keep = [x for k, x in enumerate(r["text"].split("\n")) if (r["doc_id"], k) not in gone]
        if keep:
            want[r["doc_id"]] = "\n".join(keep)
    assert {r["doc_id"]: r["text"] for r in c} == want and all(r["n_chars"] == len(r["text"]) for r in c)
    fp = {i: plain_fingerprint(t) for i, t in want.items()}
    classes = plain_classes(sorted(fp), lambda x, y: (fp[x] ^ fp[y]).bit_count() <= 3)
    assert {r["doc_id"] for r in d} == set(classes.values())
    assert {r["doc_id"] for r in e} <= {r["doc_id"] for r in d} and max(Counter(r["doc_id"] for r in e).values()) <= 2
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in f) == Counter((r["doc_id"], tuple(ref.encode_ordinary(r["text"]))) for r in e)
    assert rows((r["doc_id"], r["ids_sha"]) for r in [{"doc_id": x["doc_id"], "ids_sha": x["decoded_sha256"]} for x in f]) == rows((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
