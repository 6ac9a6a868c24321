"""Packing, digests, toxicity, archives, pages and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import as_docs, edge_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dockpulse.llm import digests, html_text, packing, toxicity, warc
from dockpulse.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


HARD = [
    (70, "It's <|endoftext|> don't I'LL  1234 ½ ²³ naïve NAÏVE étude Σίσυφος ΣΑΣ İstanbul"),
    (71, "tabs\tand\x0bvertical\x1cseparators\x85next space 　wide x_y __ ... ?!\x00\x01"),
    (72, "日本語 テキスト 한국어 😀👍🏽 ﬁne ª º µ ×÷ «quoted» –dash—"),
    (73, "a" * 5000),
    (74, "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <| |> end.<|endoftext|>"),
    (75, "\u0130X, \u03a3. \u00e9! e\u0301, x\u0301. \u03a3\u0391\u03a3; don't. 'S, a.b, c.,d e,\nf. g,\th,"),
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name):
    """Word-wise where the tokenizer allows it, else text by text."""
    path = public_tokenizers.path(name)
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    assert words._by_words == (name == "word_bpe_49k.json")
    texts = [t or "" for _, t in edge_rows() + HARD] * 2
    for text, ids in zip(texts, words.encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_that_need_more_than_two_bytes(spark):
    assert packing.id_type(PATH, 1) == "<u2" and packing.id_type(PATH, 1 << 16) == "<u4"
    pieces = packing.pack(as_docs(spark, HARD), PATH, end_id=70_000).collect()
    plain = Tokenizer.from_file(PATH)
    for i, text in HARD:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [70_000], "<u4")
        for p in [p for p in pieces if p.doc_id == i]:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_a_round_trip(spark, tokenizer, capacity):
    rows = edge_rows() + HARD
    pieces = packing.pack(as_docs(spark, rows), PATH, capacity=capacity, piece=capacity // 4).collect()
    texts = defaultdict(list)
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        texts[i].append(np.array(ids, "<u4"))
    windows = defaultdict(list)
    seen = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for i, versions in texts.items():
        covered = defaultdict(int)
        for start, length, crc, total in seen[i]:
            covered[total] += length
            assert any(
                len(ids) == total and zlib.crc32(ids[start : start + length].tobytes()) == crc
                for ids in versions
            )
        wanted = defaultdict(int)
        for ids in versions:
            wanted[len(ids)] += len(ids)
        assert covered == wanted


def test_packing_of_nothing(spark):
    assert packing.pack(as_docs(spark, edge_rows()).limit(0), PATH).count() == 0


def test_little_padding():
    rng = random.Random(2)
    docs = ((i, bytes(2 * rng.randrange(1, 3000))) for i in range(1500))
    filled = defaultdict(int)
    for rows in packing.pack_share(docs, 2048, packing.PIECE, 0):
        for _, _, length, _, _, window, _ in rows:
            filled[window] += length
    padding = sum(2048 - n for n in filled.values() if n & (n - 1))
    assert padding < 0.03 * 2048 * len(filled)
    assert max(filled.values()) <= 2048


def test_differencing_balances():
    rng = random.Random(4)
    for ways in (2, 3, 7):
        sizes = [rng.randrange(1, 400) for _ in range(60)]
        groups = packing.difference_partition(sizes, ways)
        assert sorted(i for g in groups for i in g) == list(range(60))
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert max(sums) - min(sums) < 40


def test_a_small_table_is_cut_at_powers_of_two():
    windows = packing.pack_unit([packing.Piece(0, 0, 300), packing.Piece(1, 0, 11)], 2048)
    assert [sum(p.length for p in w) for w in windows] == [256, 32, 16, 4, 2, 1]


def test_digests_against_the_order_of_documents(spark):
    rows = edge_rows()
    found = digests.compare_with_next(as_docs(spark, rows)).collect()
    assert len(found) == len(rows)
    by_text = defaultdict(set)
    lengths = defaultdict(list)
    for i, text in rows:
        lengths[i].append(len(text or ""))
    for r in found:
        assert r.n_chars in lengths[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    plain = [(i, t or "") for i, t in rows if i not in (None, 12, 14)]
    single = sorted(plain, reverse=True)
    ends = {r.doc_id: r for r in digests.compare_with_next(as_docs(spark, plain)).collect()}
    for at, (i, text) in enumerate(single):
        after = single[(at + 1) % len(single)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert ends[i].edited_sha256 == brute.sha(edited.encode())
        by_text[text].add(ends[i].fingerprint)
        by_text[edited].add(ends[i].edited_fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert ends[2].fingerprint == "" and ends[5].fingerprint == ends[7].fingerprint
    assert digests.compare_with_next(as_docs(spark, rows).limit(0)).count() == 0


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(1, "abc" * 100)], "doc_id long, text string")
    r = digests.compare_with_next(docs).first()
    assert r.near_next == 1.0 and r.n_chars == 300


def test_levels_are_window_entropies():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 105, 700).astype(np.uint8)
    text[200:330] = 97
    levels = digests.window_levels(text)
    for at in range(len(levels)):
        mass = int(digests._MASS[np.bincount(text[at : at + 64])].sum())
        assert levels[at] == (digests._TOP - mass) * (digests.LEVELS - 1) // digests._TOP
    assert levels[230] == 0


def test_likeness_follows_the_shared_part(spark):
    rng = random.Random(8)
    text = " ".join(str(rng.getrandbits(40)) for _ in range(400)).encode()
    other = " ".join(str(rng.getrandbits(40)) for _ in range(400)).encode()
    mixed = [text[: len(text) * k // 4] + other[len(text) * k // 4 :] for k in range(5)]
    ranks = np.arange(digests.LEVELS)
    prints = digests.fingerprints(mixed, digests.levels_of(mixed), ranks)
    near = [digests.likeness(prints[4], p) for p in prints]
    assert near == sorted(near) and near[4] == 1 and near[0] < 0.1 and 0.5 < near[3] < 0.9


def toxic_corpus(n=900):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % rng.randrange(300) for _ in range(rng.randrange(5, 60))]
        toxic = i % 9 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "grimez%d" % i]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_words_are_learned_without_held_out_labels(spark):
    rows, labels = toxic_corpus()
    docs = as_docs(spark, rows + [(None, None), (5000, ""), (5000, "")])
    known = spark.createDataFrame(labels + [(7000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, ["doc_id"]).select("doc.doc_id", "score").collect()
    assert len(scored) == len(rows) + 3
    truth = dict(labels)
    held = [(truth[r.doc_id], r.score) for r in scored if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(t) for t, s in held]) > 0.97
    assert all(r.score < 0.5 for r in scored if r.doc_id in (None, 5000))
    clean = toxicity.without_toxic(docs, known)
    assert clean.columns == docs.columns and 0 < docs.count() - clean.count() < 150
    nothing = toxicity.fit(docs, known.limit(0), ~toxicity.held_out(F.col("doc_id")))
    assert max(r.score for r in toxicity.score(docs, nothing, ["doc_id"]).collect()) < 1e-6
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_the_risk_is_not_driven_below_zero():
    """Even unlabelled text that is half toxic gives weights to the toxic word alone."""
    positive = [b"bad word%d" % (i % 7) for i in range(60)]
    unlabelled = positive[:30] + [b"good word%d" % (i % 7) for i in range(30)]
    model = toxicity.train(positive, unlabelled, prior=0.5)
    score = lambda t: model.bias + sum(model.weights.get(f, 0) for f in toxicity.features(t))
    assert score(b"bad word1") > 0 > score(b"good word1")


def test_archive_audit_finds_each_fault(spark):
    rows = [(i, f"http://x/{i}", "p" * (i * 37 % 900)) for i in range(400)] + [(None, None, None), (5, "u", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    original = warc.archive(pages, file_pages=128).cache()
    assert original.count() == 402
    assert warc.audit(original, original).count() == 0
    broken = original.selectExpr(
        "file", "offset", "length", "page_id",
        "CASE WHEN page_id IN (17, 300) THEN sha2(digest, 256) ELSE digest END AS digest",
    ).where("page_id IS NULL OR page_id <> 44")
    extra = spark.createDataFrame([(9, 70_000_000, 10, 1000, "f" * 64)], broken.schema)
    found = warc.audit(original, broken.unionAll(extra), range_bytes=4096, fanout=4)
    assert sorted((r.page_id, r.fault) for r in found.collect()) == [
        (17, "changed"), (44, "missing"), (300, "changed"), (1000, "added"),
    ]
    assert warc.audit(original, original.limit(0)).count() == 402
    assert warc.audit(original.limit(0), original.limit(0)).count() == 0


def test_the_registered_audit_with_repeated_and_missing_ids(spark, tmp_path):
    """Damage is done to ids that leave 1 by 101, 3 by 97 and 2 by 103, to nothing else."""
    ids = [*range(20), 15, 15, None, None, None, 102, 102, 100, 105]
    rows = [(i, f"u{n % 7}", f"<p>page {n}</p>") for n, i in enumerate(ids)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = [(r.page_id, r.fault) for r in QUERIES["op5_warc_fixity"](spark, str(tmp_path)).collect()]
    expected = [(1, "missing"), (102, "missing"), (102, "missing"), (3, "changed"), (100, "changed")]
    expected += [(2, "changed"), (105, "changed")]
    assert sorted(found) == sorted(expected)
    pages.where("page_id = 15 OR page_id IS NULL").write.parquet(f"{tmp_path}/sound/pages.parquet")
    assert QUERIES["op5_warc_fixity"](spark, f"{tmp_path}/sound").count() == 0


def test_archive_offsets_are_those_of_the_bytes(spark):
    rows = [(1, "u", "é" * 3), (2, None, None), (3, "v", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    blob = b""
    for r, (_, url, html) in zip(warc.archive(pages).orderBy("offset").collect(), rows):
        body = (html or "").encode()
        record = (
            f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\n"
            f"Content-Length: {len(body)}\r\n\r\n"
        ).encode() + body + b"\r\n\r\n"
        assert (r.offset, r.length, r.digest) == (len(blob), len(record), hashlib.sha256(record).hexdigest())
        blob += record


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies on this site to serve you better, please accept.</div>{}"
    "<div class='ad'>Buy a very good thing at a very good price from us today</div>"
    "<section id=comments><p>I think that this is the best text I have read in a long time.</p></section>"
    "<form>Search <input><button>Go</button></form><footer>&copy; us</footer></body></html>"
)


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<article><h1>Head</h1><p>One  &amp; <b>two</b>\nthree.<p>Short<br>line</article>", "Head\nOne & two three.\nShort line"),
        ("<main><p>Text of the page itself, long enough.</p><aside>side</aside><p>End.</p></main>", "Text of the page itself, long enough.\nEnd."),
        ("<div><h2>Head</h2><p>Text of the page itself, long enough to stand out.</p><p>End.</p></div>", "Head\nText of the page itself, long enough to stand out.\nEnd."),
        ("<form><article><p>Inside a form around all of it</p></article></form>", "Inside a form around all of it"),
        ("", ""),
    ],
)
def test_main_text(body, expected):
    assert html_text.main_text(PAGE.replace("{}", body)) == expected


@pytest.mark.parametrize("html", ["", "plain", "<p>", "<<<", "</div></p>", "<p>a<script>", "&amp", "<!-- x", "<a b='"])
def test_odd_pages(html):
    expected = {"plain": "plain", "<p>a<script>": "a", "<<<": "<<<", "&amp": "&"}
    assert html_text.main_text(html) == expected.get(html, "")


def test_text_around_inline_elements_that_are_left_out():
    page = "<article><p>Hello <script>var x;</script><b>you</b> <button>Go</button>there</p></article>"
    assert html_text.main_text(page) == "Hello you there"


def test_pages_table(spark):
    rows = [(1, "u", "<p>x</p>"), (2, None, None), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = [tuple(r) for r in html_text.extract(pages).collect()]
    assert sorted(found, key=repr) == sorted([(1, "u", "x", 1), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    """Each stage against what its operator decides on its own input."""
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        if name == "packing":
            break
        assert after.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id: r for r in after.collect()}
        assert kept.keys() <= ids and len(kept) >= 0.85 * len(ids)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "line_dedup":
            left = {i: h for i, n, d, h in brute.lines(rows) if n > d}
            assert {i: brute.sha(r.text.encode()) for i, r in kept.items()} == left
        if name == "simhash":
            found = brute.near_components([(i, brute.simhash(t)) for i, t in rows])
            assert kept.keys() == {c for *_, c in found}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            for i, n, hit, _ in brute.contamination(rows, items):
                assert (i in kept) == (2 * hit <= n)
                if i in kept and hit:
                    assert not brute.contamination([(i, kept[i].text)], items)[0][2]
                elif i in kept:
                    assert kept[i].text == dict(rows)[i]
            assert all(r.n_chars == len(r.text) for r in kept.values() if r.text is not None)
        before = after
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 150
