"""Each operator against a brute-force version on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import chat, chunked_bpe, near_dup, packing, pairwise_quality, quality_rules, token_count, toxicity, voronoi, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "   \n\t", "one two", "don't  stop\n\n  now 123 <|endoftext|>", "Ünïcödé 中文字 ½ ①\x85\xa0\x1c ἈΣ",
    " ".join(f"w{i % 97}" for i in range(9000)), "a" * 40_000, "x " * 10_000 + "\n" * 700 + "'ll", "α" * 700 + " " + "β γ" * 9000,
    "# $ % & | < > *", "line\nline\nline\nother line", " ".join("the quick brown fox jumps over the lazy dog".split() * 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "clash", 5) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s1", 5, "clash", 5), (7, TEXTS[7], "en", "s1", 5, "clash", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def word_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rules(docs, empty):
    judged = quality_rules.judge(docs)
    assert set(docs.columns) < set(judged.columns)
    for r in judged.collect():
        q = r.quality_rules
        expected = word_counts(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == expected
        assert q.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (q.base_failed and q.kept)
    assert quality_rules.judge(empty).count() == 0


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = token_count.count_tokens(docs, path, 100).collect()
    text = {**dict(enumerate(TEXTS)), None: "no id"}
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = text[r.doc_id] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)
    assert token_count.count_tokens(empty, path, 100).count() == 0


def test_proven_tokens_encode_alone():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = token_count.prove_whole_tokens(path)
    tok = token_count.library(path)
    assert 40_000 < len(whole) < tok.get_vocab_size()
    assert all(len(tok.encode(s).ids) == 1 for s in sorted(whole)[::97])


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (400, 100), (16_384, 512)])
def test_chunked_bpe(docs, empty, chunk, overlap):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = chunked_bpe.encode(docs, path, chunk=chunk, overlap=overlap).collect()
    text = {**dict(enumerate(TEXTS)), None: "no id"}
    assert Counter(r.doc_id for r in rows) == Counter([*range(len(TEXTS)), None, 7])
    for r in rows:
        t = text[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids, bytes(r.decoded)) == (len(ids), " ".join(map(str, ids)), t.encode())
    assert chunked_bpe.encode(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 2, size=256).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in {**dict(enumerate(TEXTS)), None: "no id"}.items()}
    covered, windows = Counter(), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        covered[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == {i: len(x) * (2 if i == 7 else 1) for i, x in ids.items()}
    for w, parts in windows.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == 256 or w == max(windows)
    assert packing.pack(empty, path, 2).count() == 0


def test_packing_mixes_to_targets(spark):
    rows = [(i, "word " * 200, "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = packing.pack(frame, public_tokenizers.path("word_bpe_49k.json"), 2, size=400, targets={"a": 0.75, "b": 0.25}).collect()
    share = defaultdict(Counter)
    for r in packed:
        share[r.sequence_id]["ab"[r.doc_id % 2]] += r.length
    for w in range(15):  # both queues last that long
        assert abs(share[w]["a"] - 300) <= 3 * packing.PACKET


def sets_of(texts, width):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        out.append(frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def test_packing_with_odd_targets(spark):
    rows = [(i, "word " * 50, "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = public_tokenizers.path("word_bpe_49k.json")

    def sources(targets, size=64):
        """The sources in output order, after checking that every document is there whole."""
        found = packing.pack(docs, path, 2, size=size, packet=4, targets=targets).collect()
        whole = {}
        for r in found:
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert whole == {i: 51 for i in range(60)} and sum(r.offset + r.length == size for r in found) == 60 * 51 // size
        return ["abc"[r.doc_id % 3] for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)) for _ in range(r.length)]

    order = sources({"a": 1.0, "b": 0.0, "c": 1.0, "absent": 5.0})
    assert "b" not in order[:40 * 51] and set(order[40 * 51:]) == {"b"}
    assert sources({"a": 0.0, "b": 0.0, "c": 0.0}).count("a") == 20 * 51
    order = sources({"a": 8.0, "b": 1.0, "c": 1.0})  # a runs dry first: the others go on
    last = len(order) - order[::-1].index("a")
    assert set(order[last:]) == {"b", "c"} and abs(order[:last].count("a") - 0.8 * last) < 64
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            packing.pack(docs, path, 2, targets={"a": bad})


def test_repeated_ids_are_one_document(spark):
    a, b, near = (" ".join(f"{w}{i}" for i in range(40)) for w in "abb")
    rows = [(1, a), (5, a), (5, b), (9, near + " z"), (9, near + " z"), (11, "quite another text of its own"), (12, None), (12, b)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == sorted(
        [(1, 1, True), (5, 1, False), (5, 1, False), (9, 1, False), (9, 1, False), (11, 11, True), (12, 12, True), (12, 1, False)])


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(3)
    base = [[f"t{x}" for x in rng.integers(0, 5000, n)] for n in (5, 30, 60, 100, 125, 150, 400, 3000)]
    texts = list(TEXTS)
    for words in base:
        for _ in range(12):
            copy = list(words)
            for at in rng.integers(0, len(copy), max(1, len(copy) // int(rng.integers(20, 60)))):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            texts.append("  ".join(copy).upper())
        texts += [" ".join(words)] * 3
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[-1], 1)], "doc_id long, text string, n int").repartition(4)
    sets = sets_of(texts, 4)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for block in (near_dup.BLOCK, 2000):  # whole clusters, and clusters split into blocks
        rows = near_dup.near_duplicates(frame, block=block).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.near_duplicates(docs).count() == len(TEXTS) + 2


def test_copy_of_a_row_without_an_id_keeps_its_links(spark):
    words = [f"w{i}" for i in range(40)]
    text, near = " ".join(words), " ".join([*words, "end"])
    frame = spark.createDataFrame([(None, text), (1, text), (2, near)], "doc_id long, text string").coalesce(1)
    rows = near_dup.near_duplicates(frame).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (1, 1, True), (2, 1, False)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in near_dup.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 90}


def test_chat(spark):
    log = [
        (1, 0, 1, "delta", "user", "Hel"), (1, 0, 2, "delta", "user", "lo"), (1, 1, 3, "delta", "assistant", "bad"),
        (1, 1, 4, "regenerate", "assistant", "x"), (1, 1, 5, None, "assistant", "</turn>\n<turn user>\\l\\"), (1, 0, 6, "edit", "user", "Bye"),
        (1, 0, 7, "delta", "user", "!"), (2, 0, None, "delta", None, None), (None, 0, 1, "delta", "a<b>\\g", "é😀"),
    ]
    events = spark.createDataFrame([(*e, 9) for e in log], "conv_id long, message long, seq long, kind string, role string, text string, start int").repartition(3)
    out = chat.render(chat.fold_messages(events))
    rows = {r.conv_id: r for r in out.select("conv_id", "formatted", "mask", chat.parse(F.col("formatted")).alias("turns"),
                                            chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "Bye!"), ("assistant", "</turn>\n<turn user>\\l\\")]
    assert rows[1].loss == "</turn>\n<turn user>\\l\\" and rows[1].formatted.count("</turn>") == 2
    assert [tuple(t) for t in rows[2].turns] == [("", "")] and rows[2].mask == []
    assert [tuple(t) for t in rows[None].turns] == [("a<b>\\g", "é😀")]
    assert chat.render(chat.fold_messages(events.limit(0))).count() == 0


def test_search_against_all_products(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), rng.normal(0, 1, 8).tolist() if i % 7 else [0.5] * 8) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, [2.0]), (305, []), (None, [9.0] * 8), (11, vectors[11][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "id long, embedding array<double>, cell int").repartition(4)
    valid = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    expected = set()
    for q in valid:
        if q % 10 == 0:
            best = sorted((-dot(valid[q], v), i) for i, v in valid.items() if i != q)[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    rows = frame.select("id", voronoi.integers(F.col("embedding")).alias("v"))
    for options in ({}, {"pivots": 3, "block": 16, "slot": 40}):
        assert {tuple(r) for r in voronoi.search(rows, 5, F.col("id") % 10 == 0, **options).collect()} == expected
    assert voronoi.search(rows.limit(0), 5, F.col("id") % 10 == 0).count() == 0


def test_search_lists_a_repeated_id_once(spark):
    """Ids with many rows, equal or not, take one place of the k; their best row counts."""
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-50, 50, 4).tolist()) for i in range(120)]
    rows += [(3, [90, 90, 90, 90 + j % 2]) for j in range(60)] + [(10, [80, -80, 80, j]) for j in range(40)] + [(7, (70 * s).tolist()) for s in np.eye(4, dtype=int)]
    frame = spark.createDataFrame(rows, "id long, v array<long>").repartition(4)
    best = {}
    for q, a in rows:
        for d, b in rows:
            if q % 10 == 0 and q != d:
                best[q, d] = max(best.get((q, d), -1 << 40), sum(x * y for x, y in zip(a, b)))
    expected = {(q, n + 1, d, -s) for q in {q for q, _ in best}
                for n, (s, d) in enumerate(sorted((-s, d) for (p, d), s in best.items() if p == q)[:5])}
    for options in ({}, {"pivots": 6, "block": 16, "slot": 20}):
        assert {tuple(r) for r in voronoi.search(frame, 5, F.col("id") % 10 == 0, **options).collect()} == expected


def test_search_holds_no_more_than_a_tile(spark):
    """Vectors and queries go to Python a row each, never as pairs of blocks, and in as few bytes as they need."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-9, 9, 6).tolist()) for i in range(400)] + [(400, [1 << 40] * 6), (401, [-(1 << 20)] * 3), (402, [])]
    frame = spark.createDataFrame(rows, "id long, v array<long>").repartition(3)
    whole = {(q, n + 1, d, -s) for q, a in rows if q % 10 == 0
             for n, (s, d) in enumerate(sorted((-sum(x * y for x, y in zip(a, b)), d) for d, b in rows if d != q)[:5])}
    for options in ({}, {"pivots": 4, "block": 8, "slot": 16, "part": 1}):
        found = voronoi.search(frame, 5, F.col("id") % 10 == 0, **options)
        assert {tuple(r) for r in found.collect()} == whole
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    packed = [voronoi._packed(v) for _, v in rows]
    assert len(packed[0]) == 13 and voronoi._unpacked(packed).tolist() == [v + [0] * (6 - len(v)) for _, v in rows]


def test_search_skips_far_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] * 1000 + rng.integers(-9, 9, 8)).astype(int).tolist()) for i in range(800)]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    found = {tuple(r) for r in voronoi.search(frame, 3, F.col("id") < 16, pivots=8).select("query_id", "vec_id").collect()}
    assert len(found) == 48 and all(q % 8 == d % 8 for q, d in found)


def test_big_products_stay_exact():
    q, x = np.array([[2**40, 1]]), np.array([[2**20, 1], [2**20, 3]])
    assert voronoi._products(q, x).tolist() == [[2**60 + 1, 2**60 + 3]]


def test_warc(spark, tmp_path):
    html = ["<p>é</p>", None, "", "a\r\nWARC/1.0\r\nb WARC/1.0\r\n\r\n", "<p>é</p>", "WARC/1.0", "ends\r\n", "x" * 100_000, "<p>é</p>"]
    rows = [(i, None if i == 2 else f"http://h/{i} z", h, 1) for i, h in enumerate(html)] + [(None, "u", "lonely", 1), (7, "http://h/7 z", "x" * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert records.filter("truncated").count() == 0 and records.count() == 3 * len(rows)
    seen = []
    for r in warc.assemble(records).collect():
        fields = dict(re.findall(r"([\w-]+): (.*)\r\n", r.metadata[0].fields))
        assert len(r.metadata) == 1 and r.request.target_uri == r.response.target_uri
        page = int(fields["page-id"]) if "page-id" in fields else None
        refers = fields.get("refers-to-page")
        text = "lonely" if page is None else html[page] or ""
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert (r.response.payload_bytes, r.response.payload_digest) == (len(text.encode()), digest)
        assert r.response.payload is None if refers else bytes(r.response.payload) == text.encode()
        seen.append((page, r.response.record_type, refers and int(refers)))
    expected = [(i, "response", None) for i in (0, 1, 3, 5, 6, 7, 7, None)] + [(2, "revisit", 1), (4, "revisit", 0), (8, "revisit", 0)]
    assert sorted(map(str, seen)) == sorted(map(str, expected))
    many = "a\r\nWARC/1.1\r\n" * 100_000
    warc.write_archives(spark.createDataFrame([(1, "u", many)], "page_id long, url string, html string"), path + "1")
    long = warc.read_archives(spark, path + "1").filter("record_type = 'response'").collect()
    assert [(bytes(r.payload), r.truncated) for r in long] == [(many.encode(), False)]
    warc.write_archives(pages.limit(0), path + "0")
    assert warc.assemble(warc.read_archives(spark, path + "0")).count() == 0


def test_foreign_archive(spark, tmp_path):
    """Both versions in one file; a chunk size with an extension; a body that ends early; a size line that is none."""
    def record(version, rid, head, body, more=0):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
        top = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <{rid}>\r\nContent-Length: {len(block) + more}\r\n\r\n"
        return top.encode() + block + b"\r\n\r\n"

    chunked = "transfer-encoding: chunked"
    parts = [record("1.0", "a", "X: 1", b"\xff\xfe"), record("1.1", "b", chunked, b"4;x=y\r\nabcd\r\n1\r\ne\r\n0\r\n\r\n"),
             record("1.1", "c", "X: 1", b"short", 100), record("1.0", "d", chunked, b"\xe9\r\nlost"), record("1.1", "e", chunked, b"9\r\npart")]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    found = {r.record_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/x.warc").collect()}
    assert {k: bytes(r.payload) for k, r in found.items() if k != "<c>"} == {"<a>": b"\xff\xfe", "<b>": b"abcde", "<d>": b"", "<e>": b"part"}
    assert [k for k, r in found.items() if r.truncated] == ["<c>"]


@pytest.fixture(scope="module")
def labelled(spark):
    good = "The report was written in the morning and it is of use to all who read it with care ."
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = " ".join(w + "%%%" for w in good.split()) if bad else f"{good} {good[i % 40:]}"
        insult = i % 5 == 0
        rows.append((i, text + (" zorgling blarf" if insult else " zorgling" if i % 5 == 1 else " blarf" if i % 5 == 2 else ""), 3))
        labels += [(i, int(not bad), int(insult))] * (2 if i == 9 else 1)
    rows += [(1000, None, 3), (1001, "", 3), (None, "text", 3), (4, rows[4][1], 3)]
    labels += [(None, 1, 1), (5000, 1, 0), (1001, None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_pairwise_quality(labelled):
    docs, labels = labelled
    rows = pairwise_quality.score(docs.drop("score"), labels).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.7) == (r.doc_id % 3 != 0) for r in rows if r.doc_id is not None and r.doc_id < 400 and held(r.doc_id))
    assert {r.score for r in pairwise_quality.score(docs.drop("score"), labels.limit(0)).collect()} == {pairwise_quality.CUT}
    assert pairwise_quality.score(docs.drop("score").limit(0), labels).count() == 0


def test_pairwise_quality_learns_from_every_label(spark, monkeypatch):
    """The rows that tell the classes apart are fewer than any sample would be sure to hold; a rare class plays in every block."""
    monkeypatch.setattr(pairwise_quality, "BLOCK", 8)
    rows = [(i, int(i % 50 == 0), [float(i % 7), float(i % 50 == 0), 1.0 * (i == 777)]) for i in range(1000)]
    known = spark.createDataFrame([(y, x, i * 7919) for i, y, x in rows], "y int, x array<double>, h long")
    blocks = pairwise_quality.dealt(known, {0: 980, 1: 20}).collect()
    assert sum(sum(1 for y in b.y if y == 0) for b in blocks) == 980 and all(1 in b.y for b in blocks)
    assert max(len(b.y) for b in blocks) < 8 * 4 + 20 + 1
    weights = pairwise_quality.fit(known, {0: 980, 1: 20})
    assert weights[1] > 0 > weights[2]  # one document of a thousand bears on the third weight
    cut = pairwise_quality.best_cut(known, weights)
    s = lambda x: sum(a * b for a, b in zip(x, weights))
    assert all((s(x) >= cut) == (y == 1) for _, y, x in rows)


def test_machine_learns_a_pair_of_words(labelled):
    docs, labels = labelled
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    wrong = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and held(r.doc_id) and (r.score >= 0.3) != (r.doc_id % 5 == 0)]
    assert not wrong
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("toxic, clean", [
    (lambda i: f"plain zörkel{i:04x} text zörkel{i + 5000:04x} here", lambda i: f"plain mufel{i:04x} text mufel{i + 5000:04x} here"),  # a stem, no word twice
    (lambda i: f"zörkel{i:04x} zörkel{i + 5000:04x} zörkel{i + 9000:04x} a", lambda i: f"zörkel{i:04x} a"),  # how often the stem stands there
    (lambda i: "one blarf of zorg in two", lambda i: "one zorg of blarf in two"),  # a pair of words that tell nothing alone
])
def test_toxic_stems_counts_and_pairs(spark, toxic, clean):
    letters = str.maketrans("0123456789", "ghijklmnop")  # runs of letters, each unlike all others
    docs = spark.createDataFrame([(i, (clean(i) if i % 3 else toxic(i)).translate(letters)) for i in range(300)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert not [r for r in toxicity.score(docs, labels).collect() if held(r.doc_id) and (r.score >= toxicity.CUT) != (r.doc_id % 3 == 0)]


def test_held_out_labels_are_never_read(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "stage")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after and after <= before, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before


def test_pipeline_with_repeated_ids_nulls_and_clashing_columns(spark):
    import corpus_pipeline

    def prose(word, n=60):
        return " ".join(f"the {word}{i} of it and" for i in range(n))

    a, b = prose("a"), prose("b")
    rows = [(1, a), (5, a), (5, b), (9, b + " z"), (9, b + " z"), (None, prose("c")), (None, prose("d")), (7, None), (8, ""), (10, "too short")]
    docs = spark.createDataFrame([(*r, "en", None, 1, "x", 2) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score string, corpus_pipeline_verdict int")
    sf = "/root/testdata/sf0.001"
    ruled = corpus_pipeline.by_rules(spark, docs, sf)
    assert sorted(map(str, (r.doc_id for r in ruled.collect()))) == sorted(map(str, (i for i, t in rows if t and len(t) > 20)))
    kept = corpus_pipeline.without_near_copies(spark, ruled, sf).collect()
    groups = [{r[1][:8] for r in rows[:2]}, {b[:8]}, {prose("c")[:8]}, {prose("d")[:8]}]
    assert len(kept) == 4 and all(sum(r.text[:8] in g for r in kept) == 1 for g in groups)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        assert name == "packing" or tuple(stage(spark, docs, sf).columns) == corpus_pipeline.COLUMNS
