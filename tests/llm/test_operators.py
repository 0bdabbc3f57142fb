"""The operators against plain versions, on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from headrisk.llm import ctph, html, lines, op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, packing, quality, sentencepieces, simhash, substrings, token_files, toxicity
from headrisk.llm.common import new_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long, quality string, n_words long, block string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def corpus() -> list[tuple]:
    pick = random.Random(5)
    vocabulary = ["".join(pick.choice("abdeginorst") for _ in range(pick.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(pick.choice(vocabulary) + pick.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    texts = [text(pick.randint(1, 220)) for _ in range(60)]
    passage, line = text(45), "  All Rights\tReserved.  "
    texts += [texts[3], texts[3], texts[4].replace(" ", "  ", 1), texts[5] + " extra", texts[7][:-6], texts[7].upper()]
    texts += [f"{text(30)} {passage} {text(20)}" for _ in range(8)] + [f"{text(60)}\n{line.upper() if i % 2 else line}\n{text(30)}" for i in range(12)]
    texts += [None, "", "", " \t\n\r ", "x", "é中 文", "\n\n", "a b c a b c a b c", "la " * 6000, text(9000), "one two three", "ONE Two three", "%%% ### " * 60, "a\tb\x0bc d　e", "<|endoftext|> hi"]
    rows = [(i * 3, t, pick.choice(["en", "de", None]), pick.choice(["s0", "s1", None])) for i, t in enumerate(texts)]
    return [(*r, 1, "old", 7, "q", 9, "b") for r in [*rows, (None, texts[8], "en", "s0"), (None, None, None, None)]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    ids = [(r[0], i % 2, int("la la" in (r[1] or ""))) for i, r in enumerate(corpus()) if i % 3]
    spark.createDataFrame([*ids, (10**9, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 3000 + "word " * 300), (None, "u", "<article><p>Kept text &amp; more</p></article>"), (3, "u", "<nav><a>x</a></nav>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def documents() -> list[tuple]:
    """(id, text or empty), ids as in sorting: null first."""
    return [(-1 if r[0] is None else r[0], r[1] or "") for r in corpus()]


def rows_of(df) -> list[tuple]:
    return [tuple(-1 if k == "doc_id" and v is None else v for k, v in r.asDict().items()) for r in df.collect()]


@pytest.mark.parametrize("op", [op1, op2, op3, op4, op5, op6, op7, op8, op9, op10], ids=lambda m: m.NAME)
def test_empty_table(spark, empty_folder, op):
    assert op.query(spark, empty_folder).collect() == []


def test_quality_counts(spark, folder):
    got = rows_of(op1.query(spark, folder))
    want = Counter()
    for i, t in documents():
        words = t.encode().split()
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeat = len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)})
        some = [x for x in t.split("\n") if x.encode().split()]
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        want[(i, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(some) - len(set(some)), repeat, failed)] += 1
    assert Counter(r[:7] for r in got) == want
    assert not any(r[7] for r in got if r[6])


def test_sketch_is_close_and_merges(spark):
    values = [int(x) for x in np.random.default_rng(1).exponential(5000, 4000)]
    docs = spark.createDataFrame([("x" if i % 3 else "y", v) for i, v in enumerate(values)], "g string, v long")
    sketch = docs.groupBy("g", F.lit("r").alias("rate"), F.expr(quality.sketch_bucket("v")).alias("bucket")).agg(F.count("*").alias("n"))
    q = quality.quartiles(quality.merged(sketch, []), []).first()
    for got, share in ((q.q1, 0.25), (q.q3, 0.75)):
        true = np.quantile(values, share, method="inverted_cdf")
        assert true * (1 - 1 / 32) - 1 <= got <= true


def test_quality_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r[0] for r in rows_of(op1.query(spark, folder)) if r[7]}
    rows = rows_of(kept)
    assert {r[0] for r in rows} == ids and all(r[5] == "old" and r[7] == "q" for r in rows)


def test_sentencepiece_is_the_library_s(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows_of(op2.query(spark, folder))
    assert len(got) == len(documents()) and all(r[3] for r in got)
    own = sentencepieces.transducer(public_tokenizers.path("piece_bpe_32k.model"))
    for t in [x for _, x in documents()] + ["=====----", "xxxxxxxxxxxxxxxx", "<s> <0x41>", "🜲 ﬁ"]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == model.encode(t)
        assert own.text(own.ids(t)) == t


def library_ids(texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, folder):
    docs = sorted(documents(), key=lambda d: d[0])
    ids = [x + [0] for x in library_ids([t for _, t in docs])]
    got = sorted(rows_of(op3.query(spark, folder)), key=lambda r: r[1])
    assert [r[0] for r in got] == [d for d, _ in docs]
    assert [r[1] for r in got] == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist() or docs[0][0] == docs[1][0]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(x), crc(x)) for (d, _), x in zip(docs, ids))


def test_one_document_from_token_files(spark, folder):
    path = new_path(spark, "files")
    token_files.write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), path, BPE)
    one = token_files.read_tokens(spark, path, 9).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in one] == [library_ids([dict(documents())[9]])[0] + [0]]


def test_fingerprints_of_neighbours(spark, folder):
    docs = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    docs = [(-1 if r[0] is None else r[0], r[1] or "") for r in docs]
    want = Counter()
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        e, own = ctph.edited(t, n), ctph.fingerprint(t.encode())
        mark = ctph.fingerprint(e.encode())
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, mark, round(ctph.likeness(own, mark), 9), round(ctph.likeness(own, ctph.fingerprint(n.encode())), 9))] += 1
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows_of(op4.query(spark, folder))) == want


def test_likeness_is_the_edit_distance():
    pick = random.Random(2)
    for _ in range(200):
        a, b = ("".join(pick.choice("abcd") for _ in range(pick.randint(1, 30))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(last[j] if x == y else 1 + min(last[j + 1], row[j]))
        assert len(a) + len(b) - 2 * ctph._common(a, b) == row[-1]
    text = "the quick brown fox jumps over it. " * 3 + "".join(chr(97 + pick.randrange(26)) for _ in range(5000))
    assert ctph.likeness(ctph.fingerprint(text.encode()), ctph.fingerprint((text[:2500] + "!" + text[2500:]).encode())) > 0.9


def test_packing_is_gapless(spark, folder):
    ids = Counter()
    for (i, _), x in zip(documents(), library_ids([t for _, t in documents()])):
        ids[(i, tuple(x + [1]))] += 1
    pieces = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), BPE).collect()
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    place, found, rest = 0, Counter(), ()
    for p in stream:
        own = tuple(np.frombuffer(p.ids, "<u4").tolist())
        assert p.sequence_id * packing.SIZE + p.offset == place and len(own) == p.length and p.start == len(rest)
        place, rest = place + p.length, rest + own
        if len(rest) == p.doc_tokens:
            found[(-1 if p.doc_id is None else p.doc_id, rest)] += 1
            rest = ()
    assert found == ids and not rest
    assert {r[3] for r in rows_of(op5.query(spark, folder))} == {zlib.crc32(p.ids) for p in pieces}


def test_html_blocks(spark, folder):
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header class=top><h1>Site</h1></header><div id='menu'><a href=x>One</a> <a>Two</a></div>"
            "<div class='cookie-notice'>We use cookies</div><main><h1>The title</h1><p>" + "word " * 40 + "<b>bo</b>ld &lt;y</p><form>Name <button>Send</button></form>"
            "<aside>related stuff</aside><p>short<script>var t='</p>';</script></p><section class=\"comments\"><p>" + "I say this " * 20 + "</p></section></main><footer>c</footer>")
    assert html.main_text(page) == "The title " + "word " * 40 + "bold <y short"
    assert html.main_text("<article><p><b>One.<br><p>Two &amp; three</p>") == "One. Two & three"
    got = sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in op6.query(spark, folder).collect())
    assert got == [(0, "Kept text & more", 16), (1, "", 0), (2, "", 0), (3, "", 0), (3, "word word word word ", 1499)]
    x, y = html.labelled_table()
    assert (html.classify(x) == (y == 1)).all()


def test_toxicity_model(spark, folder):
    got = rows_of(op7.query(spark, folder))
    assert len(got) == len(documents()) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in got)
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in got if r[0] >= 0)


def test_toxicity_on_held_out_texts(spark):
    pick = random.Random(3)
    words = ["".join(pick.choice("abdeginorst") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [pick.choice(words) for _ in range(pick.randint(20, 120))]
        for _ in range(3 * toxic):
            text[pick.randrange(len(text))] = pick.choice(["Vile!", "rotten", "nasty"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    scored = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in scored if r.held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95


def test_model_is_a_distribution():
    words = np.array([[5, 40, 10, 0], [2, 3, 0, 9]], float)
    model = toxicity.Model(np.array([1, 2, 3], np.uint64), words, np.array([2, 3, 1, 1.0]), words, np.array([1, 5, 6, 15]), np.array([[4, 20, 5, 0], [0, 1, 0, 4]], float))
    for c in (0, 1):
        assert model.uni[c].sum() == pytest.approx(1)
        for v in range(4):
            p = np.exp(model.left[c][v]) * model.uni[c]
            for k, key in enumerate(model.pairs):
                if key // 4 == v:
                    p[key % 4] = np.exp(model.pair_log[c][k])
            assert p.sum() == pytest.approx(1, abs=1e-6)


def test_substrings_by_brute_force(spark, folder):
    docs = sorted(((i, t.encode().split()) for i, t in documents()), key=lambda d: d[0])
    first: dict = {}
    want = Counter()
    for i, words in docs:
        for k in range(len(words) - substrings.WINDOW + 1):
            first.setdefault(tuple(words[k:k + substrings.WINDOW]), (i, k))
    for i, words in docs:
        gone = {k + j for k in range(len(words) - substrings.WINDOW + 1) if first[tuple(words[k:k + substrings.WINDOW])] < (i, k) for j in range(substrings.WINDOW)}
        left = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want[(i, len(words), len(gone), hashlib.sha256(left).hexdigest())] += 1
    assert Counter(rows_of(op8.query(spark, folder))) == want


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k:k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_simhash_by_all_pairs(spark, folder):
    docs = documents()
    marks = [plain_fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    least = {g: min(docs[k][0] for k in range(len(docs)) if group[k] == g) for g in set(group)}
    want = Counter((i, f"{m:016x}", least[g]) for (i, _), m, g in zip(docs, marks, group))
    got = Counter((r[0], r[1], -1 if r[2] is None else r[2]) for r in rows_of(op9.query(spark, folder)))
    assert got == want


@pytest.mark.parametrize("m", range(5, 9))
def test_cells_lose_no_link(m):
    pick = np.random.default_rng(m)
    base = pick.integers(0, 2**63, 500, np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << pick.integers(0, 64, 500).astype(np.uint64)
    assert (simhash.cells(base, m) == simhash.cells(near, m)).any(axis=1).all()


def test_large_cells_are_searched():
    pick = np.random.default_rng(1)
    fps = np.unique(np.r_[np.uint64(12345) ^ (np.uint64(1) << pick.integers(0, 64, 300).astype(np.uint64)), pick.integers(0, 2**63, 200, np.uint64)])
    a, b = simhash.cell_links(np.zeros(len(fps), np.int64), fps, 4)
    group = np.arange(len(fps))
    for x, y in zip(a, b):
        group[group == max(group[x], group[y])] = min(group[x], group[y])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert all(len(set(group[near[i]])) == 1 for i in range(len(fps))) and len(a) < 2 * len(fps)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 99)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == got[101] == 99


def test_lines_by_brute_force(spark, folder):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    often = Counter(k for _, t in documents() for k in {key(x) for x in t.split("\n")} if k)
    want = Counter()
    for i, t in documents():
        own = t.split("\n")
        left = [x for x in own if often[key(x)] < 10]
        want[(i, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())] += 1
    got = Counter(rows_of(op10.query(spark, folder)))
    assert got == want and sum(r[2] for r in want) >= 12


def test_perfect_hash():
    pick = np.random.default_rng(0)
    h1, h2 = pick.integers(0, 2**63, (2, 5000), np.uint64)
    h1[:50] = h1[0]
    mph = lines.PerfectHash(lines.build_mph(h1, h2))
    assert sorted(mph.index(h1, h2).tolist()) == list(range(5000))
    assert lines.PerfectHash(lines.build_mph(h1[:0], h2[:0])).index(h1[:2], h2[:2]).tolist() == [-1, -1]


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = simhash.keep_first(docs)
    assert one.columns == docs.columns
    assert one.count() == simhash._grouped(docs, 4, 4).select("root").distinct().count()
    assert lines.drop_common_lines(docs).columns[:len(docs.columns)] == docs.columns
    assert substrings.remove_repeats(docs).columns[:len(docs.columns)] == docs.columns


def test_toxicity_model_grows_with_the_corpus(spark):
    """Every word and pair met LEAST times has an entry, with a plain Kneser-Ney model's values, though each is rarer than one in 20,000 tokens."""
    pick = random.Random(11)
    texts = [(" ".join(f"w{pick.randrange(4000)}" for _ in range(300)) + (f" vile{i // 4 % 60} slur{i // 4 % 60}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(720)]
    rows = [(bytearray(zstandard.compress(t.encode())), y) for t, y in texts]
    entries, other = toxicity.train(spark.createDataFrame(rows, "pressed binary, toxic int"))
    got = {r.name: (r.word_gap, r.left) for r in entries.collect()}
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in texts:
        own = t.encode().split()
        words[y].update(own)
        pairs[y].update(zip(own, own[1:]))
    total, n_words, n_pairs = [sum(c.values()) for c in words], len(words[0] | words[1]), len(pairs[0] | pairs[1])
    known = lambda counts, x: max(counts[0][x], counts[1][x]) >= toxicity.LEAST
    own = lambda counts, c, x: max(counts[c][x] - toxicity.DISCOUNT, 0) if known(counts, x) else 0.0
    rest = [1 - sum(own(words, c, w) for w in words[c]) / total[c] for c in (0, 1)]
    before, context, kept = Counter(b for _, b in pairs[0] | pairs[1]), [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (a, b), n in pairs[c].items():
            context[c][a] += n
            kept[c][a] += own(pairs, c, (a, b))
    uni = lambda c, w: own(words, c, w) / total[c] + rest[c] * (before[w] + 1) / (n_words + n_pairs + 1)
    left = lambda c, w: 1 - kept[c][w] / max(context[c][w], 1)
    name = lambda w: xxhash.xxh64_intdigest(w)
    signed = lambda x: int(np.array([x], np.uint64).view(np.int64)[0])
    want = {signed(name(w)): (np.log(uni(1, w) / uni(0, w)), np.log(left(1, w) / left(0, w))) for w in words[0] | words[1] if known(words, w)}
    for a, b in pairs[0] | pairs[1]:
        if known(pairs, (a, b)):
            p = [own(pairs, c, (a, b)) / max(context[c][a], 1) + left(c, a) * uni(c, b) for c in (0, 1)]
            want[signed(toxicity.pair_names(np.array([name(a)], np.uint64), np.array([name(b)], np.uint64))[0])] = (np.log(p[1] / p[0]), None)
    assert got.keys() == want.keys() and other == pytest.approx(np.log(rest[1] / rest[0]))
    for k, (gap, back) in want.items():
        assert got[k][0] == pytest.approx(gap) and (back is None) == (got[k][1] is None) and (back is None or got[k][1] == pytest.approx(back, abs=1e-9))
    assert all(signed(name(f"vile{i}".encode())) in got for i in range(60)) and sum(total) > 200_000


@pytest.mark.parametrize("hot,full", [(toxicity.HOT, False), (300, False), (0, False), (300, True)])
def test_toxicity_measures_by_a_plain_loop(spark, monkeypatch, hot, full):
    """Whatever part of the entries is broadcast, and however full the filter is, a text has the measures of a loop over its words and all entries."""
    if full:
        monkeypatch.setattr(toxicity, "tail_filter", lambda entries, most: np.full((2, toxicity.SEGMENT_BYTES), 255, np.uint8))
    pick = random.Random(4)
    words = [f"w{int(pick.paretovariate(0.7))}" for _ in range(60_000)]
    texts = [" ".join(words[i:i + 150]) + (" vile slur" if i % 1200 == 0 else "") for i in range(0, 60_000, 150)]
    entries, other = toxicity.train(spark.createDataFrame([(bytearray(zstandard.compress(t.encode())), int("vile" in t)) for t in texts[:300]], "pressed binary, toxic int"))
    given = {r.name % 2**64: r for r in entries.select("name", F.col("word_gap").cast("float"), F.col("left").cast("float")).collect()}
    other = float(np.float32(other))
    assert len(given) > 1000
    asked = [*texts[250:], "never seen words", "", None, texts[300], "VILE, slur!", "w1 " * 3000]
    want = []
    for t in asked:
        names = [xxhash.xxh64_intdigest(w) for w in re.sub("[!,]", " ", (t or "").lower()).encode().split()]
        out = []
        for i, w in enumerate(names):
            pair = given.get(int(toxicity.pair_names(np.array([names[i - 1]], np.uint64), np.array([w], np.uint64))[0])) if i else None
            gap, back = given[w].word_gap if w in given else other, given[names[i - 1]].left if i and names[i - 1] in given else 0.0
            out.append(pair.word_gap if pair else gap + back)
        want.append((sum(out) / max(len(out), 1), sum(max(x - toxicity.STRONG, 0) for x in out), len(out)))
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.difference, r.strong, r.n) for r in toxicity.measured(docs, entries, other, hot).collect()}
    assert len(got) == len(asked)
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, abs=1e-9), i


def test_toxicity_hot_entries_keep_their_bound(spark):
    entries = spark.createDataFrame([(i, 0.5, None, 3 + i % 40) for i in range(1000)], "name long, word_gap double, left double, n long")
    for most in (0, 24, 25, 60, 999, 1000):
        (names, _, _), least = toxicity.hot_entries(entries, most)
        assert len(names) <= most and (np.diff(names.astype(float)) > 0).all()
        assert len(names) + entries.where(toxicity._rank(entries.n) < least).count() == 1000
    assert len(toxicity.hot_entries(entries, 1000)[0][0]) == 1000 and 0 < len(toxicity.hot_entries(entries, 500)[0][0])


def test_html_without_end_tags():
    text = "word " * 40 + "end"
    for page in (f"<datalist><option value=a><option value=b></datalist><article><p>{text}</p></article>", f"<div><button>Send</div><article><p>{text}</article>",
                 f"<select><optgroup><option>a<option>b<optgroup><option>c</select><article>{text}</article>", f"<button>Go<article>{text}</article>",
                 f"<object data=x><p>None</object><article>{text}</article>", f"<select><option>a<main>{text}</main>",
                 f"<article><p class=notice>We note<p>{text}</article>", f"<article><p class=notice>We note<div>{text}</div></article>",
                 f"<article><ul><li class=share>Share<li>{text}</ul></article>", f"<article><dl><dt class=ad>Ad<dd>{text}</dl></article>",
                 f"<article><table><tr><td class=share>Share<td>{text}<tr><td class=ad>Ad</table></article>", f"<html><head><title>T</title><meta x><body><article><p>{text}</article>",
                 f"<article><table><tr class=ad><td>Ad<tr><td>{text}</table></article>"):
        assert html.main_text(page) == text, page
    found = html.blocks("<main>one<div>two<button>Send</div>three<ul><li><button>Go<li>four</ul><p>five <button>Go</button> six</main>")
    assert [b.text for b in found] == ["one", "two", "three", "four", "five six"]
    inner = "<article><ul><li>" + text + "<ul class=share><li>Share<li>More</ul><li>" + text + "</ul></article>"
    assert html.main_text(inner) == f"{text} {text}"
    assert html.main_text(f"<article><p>{text}</p><template><article>Not shown</article></template><svg><title>t</title><text>None</text></svg></article>") == text


def test_rows_with_one_id_are_edited_by_themselves(spark):
    pick = random.Random(8)
    text = lambda n: " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    a, b, c = text(90), text(30), text(45)
    rows = [(1, a), (5, a), (5, text(60)), (5, f"{b} {text(50)}"), (5, f"{text(40)} {b}"), (5, f"{b} {text(25)}"), (7, c), (7, c), (7, c.replace(" ", "  ", 1)), (9, f"{c} {text(20)}"),
            (None, text(70)), (None, f"{b} {text(50)}"), (None, f"{text(22)} {b}"), (None, f"{b} {b} {text(10)}"), (None, None), (8, a)]
    docs = sorted(((-1 if i is None else i, (t or "").encode().split()) for i, t in rows), key=lambda d: d[0])
    starts: dict = {}
    for i, words in docs:
        for k in range(len(words) - substrings.WINDOW + 1):
            starts.setdefault(tuple(words[k:k + substrings.WINDOW]), set()).add((i, k))
    want: Counter = Counter()
    for i, words in docs:
        again = [k for k in range(len(words) - substrings.WINDOW + 1) if min(starts[tuple(words[k:k + substrings.WINDOW])]) < (i, k)]
        gone = {k + j for k in again for j in range(substrings.WINDOW)}
        want[(i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone))] += 1
    for parts in (1, 6):
        done = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert Counter((-1 if r.doc_id is None else r.doc_id, r._n_words, r._n_removed, " ".join(r.text.split()).encode()) for r in done) == want
    assert sum(r[2] for r in want) > 200


CLASHES = ["_key", "_row", "_fp", "_many", "_own", "_first", "_shared", "_a", "_b", "_kind", "_doc", "_n_words", "_n_removed", "_block", "_h1", "_h2", "_n_lines", "_n_dropped", "_rest", "_", "quality", "limits",
           "_q", "_salt", "_lang", "mark", "part", "place", "block", "doc", "root", "fp", "odd name"]


@pytest.mark.parametrize("name,run", [("keep_good", quality.keep_good), ("drop_common_lines", lines.drop_common_lines), ("keep_first", simhash.keep_first), ("remove_repeats", substrings.remove_repeats)])
def test_columns_with_names_of_the_operators_own(spark, name, run):
    rows = [(r[0], r[1], r[2], r[3]) for r in corpus()[:70]]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    full = plain.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(CLASHES)])
    got, want = run(full), run(plain)
    assert got.columns[:len(full.columns)] == full.columns and len(set(got.columns)) == len(got.columns)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    rows = got.select(full.columns).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == texts(want)
    assert all(r[c] == (None if r["doc_id"] is None else f"{i}:{r['doc_id']}") for r in rows for i, c in enumerate(CLASHES))


def test_driver_holds_the_frequent_entries_once(spark):
    """What the driver allocates for them, and for the filter of the others, stays near the size of what it gives."""
    entries = spark.range(600_000).select(F.xxhash64("id").alias("name"), (F.col("id") / 7).cast("float").alias("word_gap"), F.when(F.col("id") % 2 == 0, 0.5).cast("float").alias("left"),
                                          F.when(F.col("id") < 400_000, 9).otherwise(3).cast("long").alias("n"))
    tracemalloc.start()
    try:
        (names, gaps, lefts), least = toxicity.hot_entries(entries, 500_000)
        held, most = sum(x.nbytes for x in (names, gaps, lefts)), tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        filled = toxicity.tail_filter(entries.where(toxicity._rank(F.col("n")) < least), 1 << 20)
        more = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(names) == 400_000 and least == 9 and most < 2 * held and more < 2 * filled.nbytes + (2 << 20)
    want = {r.name: (r.word_gap, r.left) for r in entries.where("n = 9").collect()}
    some = range(0, len(names), 997)
    assert (names[1:] > names[:-1]).all() and all((gaps[i], None if np.isnan(lefts[i]) else lefts[i]) == want[int(names[i].astype(np.int64))] for i in some)
    tail = toxicity.as_unsigned(np.array([r.name for r in entries.where("n = 3").limit(1000).collect()], np.int64))
    assert toxicity._held(tail, filled).all()
