"""Operators against brute force, and on odd inputs."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontaminate, html_text, language_id, license_scan, minhash_dedup, mixing, quality_rules, queries, token_binary, token_counts, token_ids, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "One two", "en"), (4, "One two", "en"), (5, "one TWO", "de"), (None, "no name here at all today", "de"), (6, BASE, "en"), (7, BASE.replace("w30 ", "x "), "en"),
    (8, BASE.replace("w5 ", ""), "fr"), (9, "é " * 3000 + "\x00 \x1c end", "fr"), (10, "lorem ipsum dolor " * 400, None), (11, "!!! ??? <|endoftext|> ...", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit(1).alias(c) for c in ("node", "h", "n", "kept", "doc_key", "score", "windows", "part", "x", "source", "n_chars")))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def components(docs):
    sets = [(d, sets_of(t)) for d, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)], d == low[root(i)]) for i, (d, s) in enumerate(sets))


def test_near_duplicates_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = docs.union(spark.createDataFrame([(d + 10_000, t) for d, t, _ in ODD if d is not None], "doc_id long, text string"))
    assert sorted(map(tuple, minhash_dedup.near_duplicates(more).collect())) == components([tuple(r) for r in more.collect()])


def crowds(sizes, seed):
    """Groups of copies of a 120-word text, each with 3 random words changed: similarities lie around the threshold."""
    rng, out = np.random.default_rng(seed), []
    for g, size in enumerate(sizes):
        for _ in range(size):
            words = [f"g{g}w{i}" for i in range(120)]
            for at in rng.choice(120, 3, replace=False):
                words[at] = f"x{rng.integers(1 << 40)}"
            out.append((len(out), " ".join(words)))
    return out


def test_near_duplicates_crowds(spark):
    docs = crowds((5, 40, 150, 600), 7)
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == components(docs)


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.zipf(1.3, 60)).astype(np.uint64) for _ in range(300)]
    got = minhash_dedup.intersections(sets[:130], sets[130:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[130:]] for a in sets[:130]]


def test_near_duplicates_odd(odd, empty):
    got = sorted(map(tuple, minhash_dedup.near_duplicates(odd).collect()), key=repr)
    by = {r[0]: r for r in got}
    assert len(got) == len(ODD) and by[1] == (1, 0, 1, True) and by[5][2:] == (4, False) and by[7][2] == by[8][2] == 6 and by[None][3]
    assert minhash_dedup.near_duplicates(empty).count() == 0
    left = minhash_dedup.deduplicated(odd)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 9, 10, 11, None], key=repr)


def test_leaks(spark, odd, empty):
    item = " ".join(f"b{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, ""), (5, BASE)], "item_id long, text string")
    words = item.split()
    docs = [(20, f"pre fix {item} post"), (21, "pre " + " ".join(words[:14] + ["zz"] + words[15:])), (22, " ".join(words[:12])), (23, f"a {item.upper()}"), (24, "a short one b"), (25, None)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.first_word, r.shared, r.total) for r in decontaminate.leaks(rows, items).collect()}
    assert set(got) == {(20, 1), (21, 1), (23, 1), (24, 2), (6, 5), (7, 5), (8, 5)} - ({(21, 1)} if 21 / 31 < 0.75 else set())
    assert got[20, 1] == (2, 26, 26) and got[24, 2] == (1, 1, 1)
    left = decontaminate.without_leaks(odd, items)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 5, 9, 10, 11, None}
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0


def best_windows(text, items):
    """item_id: (shared, total, starts) of the best of all windows, where 0.75 is reached."""
    out = {}
    words = WORD.findall((text or "").lower())
    for item_id, item in items:
        own = WORD.findall((item or "").lower())
        if not own:
            continue
        width = min(5, len(own))
        of = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        bag, grams = collections.Counter(of(own)), of(words)
        n = min(len(own), len(words)) - width + 1
        if n < 1 or not bag.keys() & set(grams):
            continue
        held, shared, best = collections.Counter(), 0, (0.0, 0, 0, [])
        for i, gram in enumerate(grams):
            held[gram] += 1
            shared += held[gram] <= bag[gram]
            if i >= n:
                gone = grams[i - n]
                shared -= held[gone] <= bag[gone]
                held[gone] -= 1
            if i >= n - 1:
                total = n + sum(bag.values()) - shared
                if shared / total > best[0]:
                    best = (shared / total, shared, total, [])
                if shared / total == best[0]:
                    best[3].append(i - n + 1)
        if 100 * best[1] >= 75 * best[2] > 0:
            out[item_id] = best[1:]
    return out


def test_leaks_brute_force(spark, sf):
    a, b = ([f"{x}{i}" for i in range(40)] for x in "ab")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    made = [(900_001, " ".join(a + b)), (900_002, " ".join(a + ["z"] + b[:39])), (900_003, "to be or not to be " * 5), (900_004, "to be or not to be " * 5), (900_005, "three word item"), (900_006, "solitary")]
    some = [made[2][1], "x " * 9 + " ".join(b + a) + " y" * 9, " ".join(a + b[:30]), " ".join(a[:20] + b), "solitary", "a three word item", "to be or not to be " * 4, " ".join(b[3:] + a + b[:3] + ["q"] + a + b), " ".join((a + b)[:40] + ["q"] + (a + b)[41:])]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(900_000 + i, t) for i, t in enumerate(some)], "doc_id long, text string"))
    both = items.union(spark.createDataFrame(made, "item_id long, text string").select(F.col("item_id").cast(items.schema["item_id"].dataType), "text"))
    pairs = [tuple(r) for r in both.collect()]
    wanted = {(r.doc_id, i): x for r in docs.collect() for i, x in best_windows(r.text, pairs).items()}
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, both).collect()}
    assert {k: (r.shared, r.total) for k, r in got.items()} == {k: x[:2] for k, x in wanted.items()}
    assert all(r.first_word in wanted[k][2] for k, r in got.items()) and any(d < 900_000 for d, _ in got)
    assert got[900_001, 900_001].first_word == 9


def test_simhash_of_many_shingles(spark):
    h = 0x1234_5678_9ABC_DEF1
    rows = spark.range(70_000).select(F.lit(1).alias("k"), F.lit(h).alias("h"))
    assert [tuple(r) for r in decontaminate.simhash(rows, "k").collect()] == [(1, 70_000, h)]


def test_language_accuracy(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows if r.held_out) >= 0.97 * sum(r.held_out for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    got = language_id.identify(odd).collect()
    assert len(got) == len(ODD) and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))
    assert language_id.identify(empty).count() == 0


def test_licenses(spark, odd, empty):
    text = "x y z. Permission is granted? Licensed under the Apache License, Version 2.0.\nall RIGHTS reserved"
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(30, text), (31, "Licensed under CC BY-NC 4.0."), (32, "all rights are not reserved")], "doc_id long, text string"))
    got = license_scan.scan_licenses(docs).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(30, "apache-2.0-notice", 1.0), (30, "all-rights-reserved", 1.0), (31, "cc-by-nc-4.0-notice", 1.0)]
    assert text.encode()[got[0].first_byte : got[0].end_byte].decode() == "Licensed under the Apache License, Version 2.0"
    changed = license_scan.TEMPLATES["mit-permission"].replace("free of charge", "at no charge").replace("sublicense, ", "")
    assert license_scan.scan_licenses(spark.createDataFrame([(1, changed)], "doc_id long, text string")).first().license == "mit-permission"
    assert license_scan.scan_licenses(empty).count() == 0


def base_of(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, sf, odd, empty, labels):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    got = sorted(((r.doc_id, *(r[c] for c in names), r.base_failed) for r in quality_rules.judge(both, rules).collect()), key=repr)
    assert got == sorted(((d, *(b := base_of(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for d, t in both.collect()), key=repr)
    assert not any(r.kept for r in quality_rules.judge(both, rules).collect() if r.base_failed)
    assert quality_rules.judge(empty, []).count() == 0 and quality_rules.learn(empty, labels) == []
    quality_rules.learn(odd, labels)
    x = np.zeros((300, len(quality_rules.FEATURES)))
    x[:100, 2] = 0.5
    assert quality_rules.cover(x, np.arange(300) < 100)[0][0].feature == "symbol_share"
    plan = quality_rules.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_tokens(spark, sf, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    plain, literal = Tokenizer.from_file(path), Tokenizer.from_file(path)
    literal.encode_special_tokens = True
    ids = [plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows]
    got = sorted(token_binary.token_digest(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    n = [r.n_tokens for r in got]
    assert [r.start for r in got] == [sum(n[:k]) for k in range(len(n))]
    key = lambda x: sorted(x, key=repr)
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids, strict=True))
    counted = token_counts.token_counts(docs, path, queries.SEPARATOR_ID, block_ids=64)
    assert key(map(tuple, counted.collect())) == key((r.doc_id, len(literal.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    files = token_binary.write_token_files(docs, path, path=str(tmp_path / "files"))
    again = token_binary.TokenFiles(spark.newSession(), files.path)
    assert again.end_id == 1 and key(map(tuple, again.read().collect())) == key(map(tuple, got))
    assert token_binary.token_digest(empty, path).count() == 0 and token_counts.token_counts(empty, path, 49407).count() == 0


def test_encoder_of_odd_words(monkeypatch):
    rng = np.random.default_rng(2)
    letters = list("abcXYZ019.,'!?-_ \t\n\r\x0b\x0c\x00\x1c\x85éÀßΣσİ\u00a0\u3000\u0301漢字🙂") + ["<|endoftext|>", "'s ", "...", "  "]
    texts = ["", *("".join(rng.choice(letters, n)) for n in rng.integers(0, 400, 300)), "word " * 400_000, "x" * 50_000]
    monkeypatch.setattr(token_ids, "CACHE_WORDS", 500)  # the table is emptied many times
    for literal in (False, True):
        coder = token_ids.Encoder(queries.tokenizer_path(), literal)
        wanted = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for some in (texts, texts[-2:]):
            ids, many = coder.encode(pa.array(some, pa.large_string()))
            assert coder.by_word and many.tolist() == [len(x) for x in wanted[-len(some) :]] and ids.tolist() == sum(wanted[-len(some) :], [])


def test_words_of_long_texts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = pa.array(["".join(rng.choice(list("abé \n."), n)) for n in (0, 5, 3000, 70_000)] + ["x" * 5000, " " * 5000, "end"])
    whole = [words.scan(d, o) for _, _, d, o in words.slices(texts)][0]
    monkeypatch.setattr(words, "SLICE_BYTES", 1000)
    parts = [words.scan(d, o) for _, _, d, o in words.slices(texts, 1 << 30)][0]
    for a, b in zip(vars(whole).values(), vars(parts).values(), strict=True):
        assert (a == b).all()


def test_variable_length_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_binary.encode(x)
        assert (token_binary.decode(control, data, n) == x).all() and len(control) == -(-n // 4)


def test_toxicity(spark, sf, odd, empty, labels):
    terms = [toxicity.Term("idiot", 7.0), toxicity.Term("disgusting", 7.0), toxicity.Term("vequ", 5.0, True)]
    match = toxicity.Automaton(terms).match
    assert [match(w) for w in ("idiot", "idi0t", "idiiot", "idi", "disgostinng", "vequte", "plain")] == [(0, 0), (0, 1), (0, 1), None, (1, 2), (2, 0), None]
    x = toxicity.Scorer(terms).features(pa.array(["he is an idiot", 'he said "idiot" to us', "", "plain words"]).cast(pa.large_string()))
    assert x[0, 0] > 10 * x[1, 0] > 0 and x[1, 4] == 1 and not x[2:].any()
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    left = toxicity.without_toxic(odd, toxicity.Model((), (0.0,) * 5 + (-5.0,)))
    assert left.columns == odd.columns and left.count() == len(ODD)


def test_toxicity_misspelled_stems():
    terms = [toxicity.Term("achkeit", 6.0, True), toxicity.Term("boco", 5.0, True), toxicity.Term("bocolin", 5.0)]
    match = toxicity.Automaton(terms).match
    assert [match(w) for w in ("achkeiten", "axhkeiten", "achkiten", "achkeeiten", "hkeiten", "bocaner", "bokolin", "bocolin")] == [(0, 0), (0, 1), (0, 1), (0, 1), None, None, (2, 1), (2, 0)]
    plain = toxicity.Automaton(terms)
    plain.may_reach = lambda word: True
    rng = np.random.default_rng(5)
    for base in ("achkeit", "bocolin"):
        for _ in range(300):
            w = list(base + "er" * int(rng.integers(2)))
            for _ in range(int(rng.integers(1, 3))):
                at = int(rng.integers(len(w)))
                w[at : at + int(rng.integers(2))] = str(rng.choice(list("abchkeit")))
            assert match("".join(w)) == plain.match("".join(w))  # the filter before the walk loses nothing


def test_mixing_weights(odd):
    for bad in ({"xx": 1.0}, {"en": 0.0}, {"en": -1.0, "de": 2.0}):
        with pytest.raises(ValueError):
            mixing.Mixture(odd, "lang", bad)
    assert mixing.Mixture(odd, "lang", {"en": 1.0, "de": 1.0}).residual >= 0


def test_license_versions_and_alignment(spark):
    t = license_scan.TEMPLATES
    docs = [(i, f"some words before {t[k].lower()} and after") for i, k in enumerate(t)]
    got = {r.doc_id: r.license for r in sorted(license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda r: r.n_matched)}
    assert got == {i: k for i, k in enumerate(t)}
    rng = np.random.default_rng(6)
    for _ in range(40):
        template = rng.integers(0, 6, 20).astype(np.uint64)
        text = np.delete(np.insert(template, rng.integers(0, 20, 3), 9), rng.integers(0, 20, 2))
        pairs = license_scan.align(text, template, 0)
        best = np.zeros((len(text) + 1, 21), int)
        for p in range(len(text)):
            for q in range(20):
                best[p + 1, q + 1] = best[p, q] + 1 if text[p] == template[q] else max(best[p, q + 1], best[p + 1, q])
        assert len(pairs) == best[-1, -1] and all(text[p] == template[q] for p, q in pairs) and pairs == sorted(set(pairs))


def test_mixing(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = mixing.Mixture(docs, "lang", {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25})
    rows = m.rated().collect()
    assert np.allclose(sum(r.n_tokens * r.rate * np.array(r.posterior) for r in rows), m.targets, rtol=0.02)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    got = mixing.mixed(odd, domain="lang", least=1.0)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == {d for d, _, _ in ODD}
    assert mixing.mixed(empty, domain="lang").count() == 0 and mixing.mixed(odd.withColumn("lang", F.lit(None).cast("string")), domain="lang").count() == len(ODD)


def test_mixing_counts_tokens(odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    key = lambda x: sorted(x, key=repr)
    got = key((r.doc_id, r.n_tokens) for r in mixing.Mixture(odd, "lang").rated().collect())
    assert got == key((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in ODD)


def test_html(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy &amp; go</div><article><h1>A &lt;title</h1><p>Some  long\n text <b>bo</b>ld.<br>More<p>Second one.<form>f</form><div id=comments><p>Nice</div></article><footer>x</footer><script>var a='</p>'</script></body>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "no tags &eacute;"), (5, "u", "<p>unclosed <b>x" + "<div>" * 500)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A <title\nSome long text bold. More\nSecond one." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[None].text == "no tags é" and got[5].text == "unclosed x"


def test_html_wrappers():
    long = "This is the text of the page, and there is a good deal of it. " * 8
    for name in ("layout with-sidebar", "has-sidebar", "elementor-widget", "social-layout", "related-article", "page-banner"):
        assert html_text.main_text(f"<body><div class='{name}'><div><p>{long}</p><p>{long}</p></div></div><p class='ad'>Buy</p></body>").count("good deal") == 16
    page = f"<body><div class='menu page'><article><p>{long}</p></article><div class='sidebar'>Side</div></div><div id='comments'>Nice</div></body>"
    assert html_text.main_text(page) == long.strip()
