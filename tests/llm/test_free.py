"""Operators with Python in their tasks, against brute force, the library or held-out labels."""

import hashlib
import os
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from placeweave.llm import bpe, decontaminate, extraction, neardup, records, toxicity

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, window int"


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 1, "r", "k", 1) for i, t in zip(ids, texts)], SCHEMA)


# --- main text of pages ---


def pages(spark, htmls):
    return spark.createDataFrame([(i, f"u{i}", h, "t", "k") for i, h in enumerate(htmls)], "page_id bigint, url string, html string, text string, key string")


def test_main_text_of_the_article_only(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a>'
        '</ul></nav><!-- c --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>One\n two.<br><p>Short.</p>'
        '<form>f</form><section class="comments"><p>I think</p></section></article><aside>side</aside><footer>&copy; x</footer>'
    )
    htmls = [page, None, "", "<div>", "plain &lt;text&gt;  only", "<article></article>", page]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extraction.extract(pages(spark, htmls)).collect()}
    text = "Title & more One two. Short."
    assert got[0] == ("u0", text, len(text)) and got[6] == ("u6", text, len(text))
    assert [got[i][1] for i in (1, 2, 3, 5)] == [""] * 4 and got[4][1] == "plain <text> only"
    assert extraction.extract(pages(spark, htmls).limit(0)).count() == 0


def test_main_text_without_an_article_element():
    body = "".join(f"<p>{'A sentence of the story number %d goes on. ' % i * 4}</p>" for i in range(4)) + "<p>End.</p>"
    html = f'<body><header>Site</header><div>{"".join("<a href=x>Go</a> " * 9)}</div><div id="content">{body}</div><div class="sidebar">s</div></body>'
    got = extraction.main_text(html)
    assert got.startswith("A sentence") and got.endswith("End.") and "Go" not in got and "Site" not in got


def test_an_unclosed_menu_does_not_swallow_the_article():
    assert extraction.main_text("<nav><ul><li>a<article><p>Text</article>") == "Text"


STORY = "".join(f"<p>{'A sentence of the story number %d goes on. ' % i * 6}</p>" for i in range(4))


def test_long_text_beside_a_teaser_article():
    teaser = '<article><h2><a href="/t">Other tale</a></h2><p>Read it here.</p></article>'
    for page in (f"{teaser}<div>{STORY}</div>", f"<main>{teaser}<div>{STORY}</div>{teaser}</main>"):
        got = extraction.main_text(f"<body>{page}</body>")
        assert got.startswith("A sentence of the story number 0") and "number 3" in got and "tale" not in got and "Read" not in got


def test_link_lists_inside_an_article_are_left_out():
    links = "".join(f'<li><a href="/{i}">Go to page {i}</a></li>' for i in range(6))
    bullets = "<ul><li>Salt</li><li>Bread with <a href=/b>oil</a></li></ul>"
    head = "<header><h1><a href=/>Title</a></h1><a href=/by>By</a></header>"
    got = extraction.main_text(f"<article>{head}<ul>{links}</ul>{STORY}{bullets}<div><ol>{links}</ol></div><p>End.</p></article>")
    assert got.startswith("Title By A sentence") and got.endswith("goes on. Salt Bread with oil End.") and "Go" not in got
    assert extraction.main_text(f"<article><ul>{links}</ul></article>").startswith("Go to page 0 Go")


FLOOD = "The river rose by a metre in one night, and the ferry stayed at its pier until the morning. " * 4


@pytest.mark.parametrize("page", [
    '<body><div class="no-sidebar"><p>{}</p></div></body>',
    '<body><main class="content has-sidebar"><p>{}</p></main></body>',
    '<body><article class="post comments-open"><p>{}</p></article></body>',
    '<body><article><section id="social-history"><p>{}</p></section></article></body>',
    '<body><article><section class="dialog-scene"><p>{}</p></section></article></body>',
    '<body><article><p class="lead-social">{}</p></article></body>',
])
def test_compound_names_are_not_marks(page):
    assert extraction.main_text(page.format(FLOOD)) == FLOOD.strip()


@pytest.mark.parametrize("mark", [
    '<div class="post-comments"><p>{}</p></div>', '<div class="sidebar"><p>{}</p></div>',
    '<p class="advert">{}</p>', '<article class="comment"><p>{}</p></article>',
])
def test_marks_inside_an_article_are_left_out(mark):
    noise = mark.format("Somebody else says something of about this length here.")
    assert extraction.main_text(f"<article><h1 class='article-header'>Flood</h1><p>{FLOOD}</p>{noise}</article>") == (
        "Flood " + FLOOD.strip()
    )


def test_stray_end_tags_take_no_time():
    page = "<div>" * 20_000 + "</section>" * 20_000 + f"<p>{FLOOD}</p>"
    started = time.time()
    assert extraction.main_text(page) == FLOOD.strip()
    assert time.time() - started < 10


def test_two_articles_of_unlike_length_are_both_taken():
    short = f"<p>{'Few words of another one. ' * 7}</p>" * 3
    got = extraction.main_text(f"<article><h2>A</h2>{STORY}</article><article><h2>B</h2>{short}</article><div>Page 1 of 2</div>")
    assert got.startswith("A A sentence") and "B Few words" in got and "Page" not in got


# --- benchmark decontamination ---


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(texts, items):
    windows = {}
    for i, text in items:
        w = leak_words(text)
        for a in [w[k : k + 10] for k in range(len(w) - 9)] if len(w) >= 10 else [w] if w else []:
            windows.setdefault(tuple(a), set()).add(i)
    out = []
    for text in texts:
        w, hit, found = leak_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(list("abcdeé"), n))
    items = [(i, word(n)) for i, n in enumerate([30, 12, 10, 9, 5, 4, 0, 25])] + [(8, None), (9, word(11)), (None, word(10)), (11, "ß")]
    items.append((12, items[0][1]))
    texts = [word(n) for n in (200, 9, 1, 0, 40)] + [None, "x " + items[0][1].upper() + " y", f"{word(6)} {items[1][1]}!", items[9][1][:-2], word(3000), "", items[10][1]]
    docs = table(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("window", F.lit(1))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == len(texts)
    for i, expected in enumerate(leaks(texts, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected, i


def test_leaks_of_repeated_rows_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = table(spark, [passage, passage, "clean text", None, passage], [1, 1, 1, 2, None])
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = decontaminate.without_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "clean text"), (2, "")]
    assert decontaminate.contamination(docs, bench).count() == 5
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.without_leaks(docs.limit(0), bench).count() == 0


# --- near-duplicates ---


def brute_classes(texts, weights):
    s = neardup.Shingles(pa.array(texts, pa.string()))
    vectors = []
    for i in range(len(texts)):
        h = s.hashes[s.first[i] : s.first[i + 1]]
        c = s.counts[s.first[i] : s.first[i + 1]]
        vectors.append(dict(zip(h.tolist(), (weights[neardup.bucket_of(h)] * c).tolist())))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            shared = sum(min(v, b.get(k, 0.0)) for k, v in a.items())
            if a and shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_classes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    texts = [None, "", " \n ", "one two", "One  two", "same " * 400, "same " * 420]
    for n in (60, 150, 400):
        base = fresh(n)
        texts.append(" ".join(base))
        for edits in [1, 1, 2, 3, 4, 6, 9]:
            copy = list(base)
            for at in rng.integers(0, n, edits):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    chain = fresh(120)
    for _ in range(8):
        texts.append(" ".join(chain))
        chain[rng.integers(0, 110)] = "z"
        chain = chain[1:] + fresh(1)
    texts += [" ".join(fresh(80)) for _ in range(20)]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in neardup.labelled(docs).collect()}
    weights = neardup.shingle_weights(docs)
    expected = brute_classes(texts, weights)
    assert {i: got[i].class_id for i in got} == dict(enumerate(expected))
    assert got[3].n_class == 2 and got[0].n_class == 1


def test_one_of_each_keeps_one_row_of_repeats_and_texts_without_words(spark):
    a = " ".join(f"w{i}" for i in range(50))
    docs = table(spark, [a, a, a + " x", "other text", None, "", a], [7, 7, 3, 3, 1, 1, None])
    kept = neardup.one_of_each(docs)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, ""), (1, ""), (3, "other text"), (3, a + " x")]
    assert kept.columns == docs.columns
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_texts_that_surely_stay_are_not_shuffled(spark):
    rows = spark.range(3000).withColumn("h", F.xxhash64("id"))
    others = rows.filter("id % 50 = 0 or id > 2950").select(F.col("h").alias("o"))
    sure, asked = neardup.maybe_among(rows, F.col("h"), others, F.col("o"))
    left, met = {r.id for r in sure.collect()}, {r.id for r in asked.collect()}
    assert left | met == set(range(3000)) and not left & met and sure.columns == rows.columns
    assert {i for i in range(3000) if i % 50 == 0 or i > 2950} <= met and len(met) < 120
    none, _ = neardup.maybe_among(rows, F.col("h"), others.limit(0), F.col("o"))
    assert none.count() == 3000
    a = " ".join(f"w{i}" for i in range(50))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = neardup.one_of_each(table(spark, [a, a, *(f"{i} text" for i in range(200))]))
        assert {r.doc_id for r in kept.collect()} == {0, *range(2, 202)}
        surely = kept._jdf.queryExecution().optimizedPlan().children().head().toString()
        assert "LeftAnti" not in surely and "rightHint=(strategy=broadcast)" in surely
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_chain_longer_than_one_round_is_one_class(spark):
    nodes = [i.to_bytes(16, "big") for i in np.random.default_rng(1).permutation(40).tolist()]
    edges = spark.createDataFrame(list(zip(nodes[:-1], nodes[1:])), "a binary, b binary")
    assert {bytes(r["class"]) for r in neardup.components(edges).collect()} == {bytes(16)}


# --- toxicity ---


def test_toxicity_learns_from_labels_and_restores_disguised_words(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("aeiou")) + rng.choice(list("bdklmnrst")) for _ in range(3)) for _ in range(300)]
    bad = ["idiot", "clown", "moron"]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 30))
        toxic = int(i % 5 == 0)
        for k in range(3 * toxic):
            w[5 + 7 * k] = bad[(i + k) % 3]
        texts.append(" ".join(w))
        labels.append((i, 1, toxic))
    texts += ["ratasa 1d10t ekarim m0r0n enadas", "ratasa i d i o t ekarim clooown", None, "", "x" * 50_000]
    docs = table(spark, texts)
    scorer = toxicity.Toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in scorer.score(docs).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(400) if got[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][2] for i in held) >= 0.95 * len(held)
    assert got[400].predicted == got[401].predicted == 1 and got[402].predicted == got[403].predicted == got[404].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = scorer.keep_clean(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}
    assert scorer.score(docs.limit(0)).count() == 0


def test_disguised_words_of_any_length_are_restored(spark):
    plain = "so you are such a stupid person and a complete idiot who is a moron too".split()
    rng = np.random.default_rng(4)
    restorer = toxicity.Restorer(toxicity.language_model(table(spark, [" ".join(rng.choice(plain, 300)) for _ in range(20)])))
    spaced = " ".join("youaresuchastupididiot")
    assert len(spaced) > 40 and {"you", "are", "such", "stupid", "idiot"} <= restorer.words(f"Well: {spaced}.")
    assert {"you", "idiot"} <= restorer.words("y o u i d i o t")
    assert {"idiot", "moron", "complete"} <= restorer.words("so_you_are_a_complete_1d10t_and_a_m0r0n_too")
    assert "idiot" in restorer.words("idi" + "o" * 60 + "t") and "idiot" in restorer.words("i-d-i-o-t")
    assert {"idiot", "moron"} <= restorer.words("so_" * 30_000 + "1d10t_m0r0n")
    digest = hashlib.sha256(b"x").hexdigest()
    assert restorer.words(digest) == set(toxicity.WORD.findall(digest))


def test_toxicity_without_labels_gives_all_the_same_score(spark):
    docs = table(spark, ["some text", None])
    scorer = toxicity.Toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert len({r.score for r in scorer.score(docs).collect()}) == 1


# --- byte-pair encoding ---

ODD = ["a<|endoftext|>b  <|endoftext|>  c", "  \n\n x", "it's I'LL", "", "\x1c\x1d \x1e", "\x85\xa0x ", " " * 50 + "z", "é" * 300, "ab" * 3000, "日本語テキスト 😀👍🏽", "Σας ΣΑΣ İ ́x"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(BYTE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_every_character_of_the_basic_plane(coder, library):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(chars[i : i + 64]) for i in range(0, len(chars), 64)] + [" ".join(chars[i : i + 64]) for i in range(0, 0x3100, 64)] + ODD
    own = [np.frombuffer(i, "<u4").tolist() for i in coder.encode(texts)]
    odd = [t[:20] for t, a, b in zip(texts, own, library.encode_batch(texts, add_special_tokens=False)) if a != b.ids]
    assert len(odd) <= 2, odd  # characters that Unicode versions class apart


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdest 'ET\n0.é日"), max_size=60))
def test_ids_and_round_trip_equal_the_library(coder, library, text):
    ids = coder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids).decode() == text


def test_encode_query_shape(spark, library):
    texts = [*ODD, None]
    docs = table(spark, texts)
    out = bpe.encode(docs, BYTE, with_ids=True)
    for r in out.collect():
        text = texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(out, BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0), BYTE).count() == 0


# --- binary records ---


def test_records_come_back_in_order(spark, tmp_path):
    word = Tokenizer.from_file(WORD)
    texts = ["b", None, "", "The cat's <|endoftext|> SAT  on\tit", "é́ Ǆ", "long word " * 5000, "dup", "dup"]
    keys = [5, 3, None, -2, 9, 7, 5, 5]
    files = records.write_records(table(spark, texts, keys), WORD, f"file://{tmp_path}/out", files=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.read_records(files).collect())
    order = sorted(zip(keys, texts), key=lambda x: (x[0] is not None, x[0] or 0))
    expected, start = [], 0
    for key, text in order:
        ids = word.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [g[1] for g in got] == [e[1] for e in expected] and [g[0] for g in got][0] == 0
    assert sorted(g[1:] for g in got if g[1] != 5 and g[1] is not None) == sorted(e[1:] for e in expected if e[1] != 5 and e[1] is not None)
    assert sum(g[2] for g in got) == start
    assert records.read_records(records.write_records(table(spark, texts).limit(0), WORD, f"file://{tmp_path}/none", files=2)).count() == 0


LINES = ["Ähre, straße... ŉ İi ǅ naïve(!) don't x1 don", "a\x1cb\x0b c\u00a0d\u2003e", "<|endoftext|>x THE ''re end", "e\u0301t\u00e9 日本 語,", "", None, " , "]


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abst 'RE\n0.,é\u0301日ſK"), max_size=40), max_size=6))
def test_columns_encode_as_the_library_does(words, texts):
    column = pa.array(["left out", *texts, *LINES], pa.string())[1:]
    expected = [words.encode(t or "", add_special_tokens=False).ids for t in [*texts, *LINES]]
    assert [i.tolist() for i in records.library(WORD).encode(column)] == expected


def test_a_worker_remembers_words_within_bounds(monkeypatch):
    coder, word = records.Library(WORD), Tokenizer.from_file(WORD)
    column = pa.array([" ".join(f"{a}{b}é{c}" for a in "abcdefghij" for b in "klmnop" for c in "qrst") + " x1, plain."])
    first = coder.encode(column)[0].tolist()
    assert first == word.encode(column[0].as_py(), add_special_tokens=False).ids
    monkeypatch.setattr(coder, "ids", None)  # a later task asks the library nothing
    assert coder.encode(column)[0].tolist() == first and records.library(WORD) is records.library(WORD)
    monkeypatch.undo()
    monkeypatch.setattr(records, "MOST_WORDS", 300)
    for n in range(3):
        texts = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + n)}" for i in range(200))])
        assert coder.encode(texts)[0].tolist() == word.encode(texts[0].as_py(), add_special_tokens=False).ids
    assert len(coder.known) <= 300


def test_shuffled_reads_and_damage(spark, tmp_path):
    files = records.write_records(table(spark, ["one", "two words", "three"]), WORD, f"file://{tmp_path}/x", files=1).collect()
    name = next(f["file"] for f in files if f["docs"] == 3)
    path = name.removeprefix("file://")
    index = open(path + ".idx", "rb").read()
    places = [int.from_bytes(index[24 * i + 8 : 24 * i + 16], "little") for i in range(3)]
    assert [k for k, _ in records.read_at(name, places[::-1])] == [2, 1, 0]
    data = bytearray(open(path + ".rec", "rb").read())
    data[places[1] + 20] ^= 1
    open(path + ".rec", "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        records.read_at(name, [places[1]])
