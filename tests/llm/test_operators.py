"""Operators against brute force on small tables with nulls, empty and long texts, copies, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import ann, html_extraction, lm_scoring, mixing, ngram_join, ogg, packed, sentencepiece_codec, sharding, suffix_dedup, toxicity

LONG = "word " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, slot int, shard int, chunk int, kind string"


def documents(spark, texts, ids=None):
    """Rows with columns whose names the operators use themselves."""
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}", None if t is None else len(t), "n", 1, 2, 3, "k") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def corpus(seed=1, n=60):
    """Texts with shared passages, near copies, exact copies, empty ones, a null and a very long one."""
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 260))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(110))
    for i in range(0, n, 5):
        base[i] += " " + passage
    for i in range(1, n, 7):
        own = base[i].split(" ")
        own[len(own) // 2] = "changed"
        base.append(" ".join(own))
    return [*base, base[3], base[3], base[10], "", "", None, "  \n ", "one", "one", "Two words", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, corpus()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def removed(texts, width, short=0):
    """Bytes in strings of this width that start twice; with short, those too in strings of that width that hold none of these."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    if short:
        begins = lambda d, i: not d[i : i + 1].isspace() and (i == 0 or d[i - 1 : i].isspace())
        twice = Counter(d[i : i + short] for d in data for i in range(len(d) - short + 1) if begins(d, i))
        for d, gone in zip(data, removed(texts, width), strict=True):
            more = gone.copy()
            for i in range(len(d) - short + 1):
                if begins(d, i) and twice[d[i : i + short]] > 1 and not gone[i : i + short].any():
                    more[i : i + short] = True
            out.append(more)
        return out
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


@pytest.mark.parametrize("order", [3, 5, 7])
def test_difference_cover(order):
    v, cover = suffix_dedup.difference_cover(order)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("group", [packed.GROUP, 1])
def test_suffix_dedup(spark, empty, monkeypatch, group):
    monkeypatch.setattr(packed, "GROUP", group)
    monkeypatch.setattr(packed, "GROUPED", 2)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4_000_000 if group > 1 else 12_000)
    texts = [t for t in corpus() if t != LONG] + ["ab" * 400, "x" * 399, "y" * 400, "é" * 500]
    got = rows(suffix_dedup.spans(documents(spark, texts).repartition(3), texts=True))
    shared = removed(texts, 400, 267)
    for i, (t, gone) in enumerate(zip(texts, removed(texts, 400), strict=True)):
        d = np.frombuffer((t or "").encode(), np.uint8)
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(d), gone.sum(), starts)
        assert got[i].kept_sha256 == hashlib.sha256(d[~gone].tobytes()).hexdigest()
        long = suffix_dedup.passages(d, shared[i], suffix_dedup.PASSAGE_WORDS)
        assert got[i].n_passages == len(long)
        lost = gone.copy()
        for a, z in long:
            lost[a:z] = True
        assert got[i].kept_text.encode() == d[~suffix_dedup.whole_characters(d, lost)].tobytes()
    if group > 1:
        assert suffix_dedup.spans(empty).count() == 0


def test_suffix_dedup_reports_passages_of_fifty_words(spark):
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(10**5)}" for _ in range(n))
    passage = text(54)
    assert 267 <= len(passage) < 400
    got = rows(suffix_dedup.spans(documents(spark, [f"{text(40)} {passage} {text(90)}", f"{text(70)} {passage}", text(200)]), texts=True))
    assert [got[i].n_passages for i in range(3)] == [1, 1, 0] and all(got[i].n_removed == 0 for i in range(3))
    assert passage not in got[0].kept_text and passage not in got[1].kept_text and got[2].n_bytes == len(got[2].kept_text)


def test_suffix_dedup_of_repetition_and_pieces(monkeypatch):
    t = suffix_dedup.Texts(b"ab" * 3000, np.array([6000]), suffix_dedup.difference_cover(3), 40)
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    suffix_dedup._POWERS.clear()
    at = np.arange(0, 5000)
    names = [suffix_dedup.fingerprints(t.data, at, 40, k) for k in (0, 1)]
    suffix_dedup._POWERS.clear()
    assert all(len(set(x.tolist())) == 2 and (x[::2] == x[0]).all() for x in names) and names[0][0] != names[1][0]


def test_names_of_parts_stand_for_strings():
    r = random.Random(2)
    d = bytes(r.choice(b"ab") for _ in range(3000))
    t = suffix_dedup.Texts(d, np.array([3000]), suffix_dedup.difference_cover(3), 40)
    at = t.fits(t.at, 40)
    for parts, length in ((1, t.short), (t.parts - 1, t.middle), (t.parts, 40)):
        by_name, by_string = (len(set(x)) for x in (t.named(at, parts).tolist(), [d[i : i + length] for i in at.tolist()]))
        assert by_name == by_string


def test_packed_sums(spark, monkeypatch):
    """Sums by levels of merged chunks are those of one level, with and without checks, for hot and rare keys."""
    rng = np.random.default_rng(4)
    chunks = {c: np.unique(np.concatenate([rng.integers(0, 1 << 64, 200, dtype=np.uint64), rng.integers(0, 1 << 64, 1, dtype=np.uint64), np.arange(50, dtype=np.uint64) << np.uint64(58)])) for c in range(9)}
    for c in (3, 7):
        chunks[c] = np.unique(np.concatenate([chunks[c], chunks[1][::3]]))
    total = Counter()
    for c, keys in chunks.items():
        total.update({int(k): c + 1 for k in keys})
    for checked in (False, True):
        sent = [packed.sent(0, c, k, np.full(len(k), c + 1), checks=packed.mixed(k) >> np.uint64(32) if checked else None) for c, k in chunks.items()]
        emitted = spark.createDataFrame([tuple(r.values()) for b in sent for r in b.to_pylist()], packed.SENT)
        for group in (512, 4, 1):
            monkeypatch.setattr(packed, "GROUP", group)
            monkeypatch.setattr(packed, "GROUPED", 2)
            got = defaultdict(list)
            answers = packed.answered(emitted, len(chunks)).collect()
            for r in sorted(answers, key=lambda r: (r.chunk, r.bucket)):
                got[r.chunk] += packed.expand(r.counts, np.int64).tolist()
            assert all(got[c] == [total[int(k)] for k in keys] for c, keys in chunks.items())
            assert (sum(r.keys_total for r in answers), sum(r.counts_total for r in answers)) == (len(total), sum(total.values()))
    monkeypatch.undo()
    masks = [packed.sent(packed.MASKS, c, np.array([7, 8 + c], np.uint64), np.array([1 << c, 1 << 40])) for c in range(4)]
    emitted = spark.createDataFrame([tuple(r.values()) for b in masks for r in b.to_pylist()], packed.SENT)
    assert {tuple(packed.expand(r.counts, np.int64)) for r in packed.answered(emitted, 4).collect()} == {(15, 1 << 40)}
    keys, same = np.array([5, 9], np.uint64), np.array([1, 2], np.uint64)
    every, _, place, _ = packed.merged([packed.pack_keys(keys)] * 2, [same.astype(np.uint32).tobytes(), np.array([1, 3], np.uint32).tobytes()])
    assert every.tolist() == [5, 9, 9] and place.tolist() == [0, 1, 0, 2]


# 2


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece(spark, docs, empty, model_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    texts = ["", None, " ", "  a\n\tb  ", "▁x ▁", "😀ሴ\U00010ffff", "<s> </s> <0x41> <unk>", "x" * 3000, "mixed 中文 текст ", LONG, "same", "same", "\x00"]
    got = rows(sentencepiece_codec.encode(documents(spark, texts), model_path))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_eos=True)
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids)
    digest = rows(sentencepiece_codec.digest(sentencepiece_codec.encode(documents(spark, texts[:2]), model_path)))
    assert digest[0].n_tokens == 1 and digest[0].ids_sha256 == hashlib.sha256(b"2").hexdigest()
    assert sentencepiece_codec.encode(empty, model_path).count() == 0


def test_sentencepiece_fuzz(model_path):
    with open(model_path, "rb") as file:
        m = sentencepiece_codec.PieceModel(file.read())
    r = random.Random(3)
    parts = [*"abc ▁\n.,'’éß中😀<>019", "  ", " the", "ing", "<s>", "<0x41>"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        own = np.frombuffer(m.encode_batch([t])[0], np.int32).tolist()
        assert own == m.library.encode(t)
        ids = [r.randrange(3, 300) if r.random() < 0.5 else r.randrange(32000) for _ in range(6)]
        assert m.decode(ids) == m.library.decode(ids)
        assert m.decode_batch(np.array(ids), np.array([0, 2, 2, 6])).to_pylist() == [m.library.decode(x) for x in (ids[:2], [], ids[2:])]


def test_sentencepiece_segments_are_cut_where_no_piece_joins(model_path):
    with open(model_path, "rb") as file:
        m = sentencepiece_codec.PieceModel(file.read())
    assert m.signs and not any(c.isalpha() for c in m.signs)
    whole = sentencepiece_codec.PieceModel(m.library.serialized_model_proto())
    r = random.Random(5)
    for _ in range(500):
        t = "".join(r.choice("aéx ▁.,1²_'\n中①ª") for _ in range(r.randint(1, 14)))
        whole.cut = r.choice([None, sentencepiece_codec.WORD])
        segments = m.cut.findall("▁" + t.replace(" ", "▁"))
        words = [t[k : k + 5] for k in range(0, len(t), 5)]
        assert m.merge_batch(words) == [np.array(m.merge(w), np.int32).tobytes() for w in words]
        assert "".join(segments) == "▁" + t.replace(" ", "▁") and m.encode_batch([t]) == whole.encode_batch([t])


# 3


def shingle_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def least_reachable(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [ngram_join.BLOCK_BYTES, 1500])
def test_ngram_join(spark, empty, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    texts = corpus(4, 50)
    r = random.Random(9)
    chain = [f"c{i}" for i in range(60)]
    for _ in range(12):  # each differs a little from the one before
        chain = chain[:]
        chain[r.randrange(60)] = f"d{r.random()}"
        texts.append(" ".join(chain))
    got = rows(ngram_join.join(documents(spark, texts).repartition(3))[0])
    sets = shingle_sets(texts)
    least = least_reachable(sets)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == least
    if block > 1500:
        assert ngram_join.join(empty)[0].count() == 0


@pytest.mark.parametrize("block", [ngram_join.BLOCK_BYTES, 1500])
def test_ngram_join_links_are_whole(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(ngram_join, "LINKS_HELD", 7, raising=False)
    words = [f"c{i}" for i in range(80)]
    texts = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 80, 4)] + [" ".join(words)] * 2 + ["alone", "", "copied twice", "copied twice", None]
    docs = documents(spark, texts).repartition(3)
    found, links = ngram_join.join(docs)
    docs_of, n_links = defaultdict(set), {}
    for r in found.collect():
        docs_of[r.node and bytes(r.node)].add(r.doc_id)
        n_links[r.doc_id] = r.n_links
    sets = shingle_sets(texts)
    linked = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert n_links == {i: sum(linked(i, j) for j in range(len(texts)) if j != i) for i in range(len(texts))}
    expected = {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and linked(i, j)}
    pairs = [(bytes(r.a), bytes(r.b)) for r in links().collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs) > len(texts)
    assert {(max(i, j), min(i, j)) for a, b in pairs for i in docs_of[a] for j in docs_of[b]} == expected


# 4


def test_toxicity(spark, empty):
    r = random.Random(2)
    plain = [f"alpha{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        own = [r.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            own[r.randrange(40)] = r.choice(["villain", "vilify"])
        texts.append(" ".join(own))
        labels.append((i, int(bad)))
    docs = documents(spark, [*texts, None, "", "a villain", LONG])
    train = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 != 1] + [(9999, 1), (None, 1), (5, None), (4, 0)], "doc_id long, toxic int")
    m = toxicity.trained(docs, train)
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 2
    got = rows(toxicity.severity(docs, m))
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 1]
    assert np.mean([got[i].rejected == bool(y) for i, y in held]) >= 0.95
    assert got[402].rejected and not got[400].rejected and not got[401].rejected and not got[403].rejected
    assert 0 <= got[400].severity < 0.5 < got[402].severity <= 2
    none = toxicity.trained(docs, train.where("toxic = 0"))
    assert all(x.severity == 0 for x in toxicity.severity(docs, none).collect())
    assert toxicity.severity(empty, m).count() == 0 and not toxicity.trained(empty, train).weights


# 5


def test_sharding(spark, empty):
    texts = [*corpus(), *["hot"] * 200]
    ids = [*range(len(texts) - 200), *[7] * 200]
    placed, slot_map = sharding.shard(documents(spark, texts, ids), 24, 256)
    got = placed.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.law == "bytes"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    versions = {v: defaultdict(int) for v in (1, 2)}
    for r in slot_map.collect():
        versions[r.version][r.shard] += r.bytes
    largest = max(r.bytes for r in slot_map.collect())
    spread = lambda v: max(versions[v].values()) - min(versions[v].values())
    assert spread(2) <= max(largest, spread(1)) and sum(versions[1].values()) == sum(versions[2].values())
    assert sharding.shard(empty)[0].count() == 0


def test_sharding_is_near_equal(spark):
    r = random.Random(5)
    texts = ["x" * r.randint(10, 900) for _ in range(4000)]
    sizes = Counter()
    for row in sharding.shard(documents(spark, texts), 24)[0].collect():
        sizes[row.shard] += row.size
    assert max(sizes.values()) / min(sizes.values()) < 1.01


# 6


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_ogg_crc_and_round_trip():
    r = random.Random(1)
    for n in (0, 1, 63, 1000):
        d = r.randbytes(n)
        assert ogg.page_crc(d) == slow_crc(d)
    for n in (64, 4096, 4160, 64 * 5001):
        d = r.randbytes(n)
        m = ogg.write_pcm8(d)
        back, features = ogg.read_pcm8(m)
        assert back == d and features["samples"] == n and features["seconds"] == n / ogg.RATE


def test_ogg_faults():
    m = ogg.write_pcm8(bytes(range(256)) * 300)
    for bad in (m[:-1], m[:40] + bytes([m[40] ^ 1]) + m[41:], m[28:], m + m[:60], b""):
        with pytest.raises(ogg.OggError):
            ogg.read_pcm8(bad)


def test_ogg_packet_over_pages():
    w = ogg.StreamWriter(5)
    big = bytes(255 * 300)
    data = b"".join(w.pages([(big, 10), (b"", 11), (b"z" * 255, 12)], True))
    s = ogg.read(data)[5]
    assert s.packets == [big, b"", b"z" * 255] and s.pages == 2 and s.granules[-1] == 12
    assert ogg.timestamps(s, [10, 1, 1], 1) == [10.0, 11.0, 12.0]


def test_ogg_documents(docs, empty):
    got = rows(ogg.digest(ogg.documents_as_media(docs)))
    for i, t in enumerate(corpus()):
        d = (t or "").encode()
        p = d + bytes(max(64, -(-len(d) // 64) * 64) - len(d))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(d), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.write_pcm8(p)).hexdigest()
    assert ogg.documents_as_media(empty).count() == 0


# 7

ARTICLE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a>menu</a></li></ul></nav><!-- x --><div class='ad'>buy</div><article><h1>Head &amp; more</h1><p><b>One<br><p>Two\n  three&nbsp;four</p><section class='comments'><p>no</p></section><form><input>f</form><script>var t='</p>'</script></article><aside>side</aside><footer>end</footer></body></html>"


def test_html_article():
    assert html_extraction.lines(ARTICLE) == (["Head & more", "One", "Two three four"], True)
    assert html_extraction.lines("") == ([], False) and html_extraction.lines("plain &lt;text") == (["plain <text"], False)
    assert html_extraction.lines("<p>a<p>b<ul><li>c<li>d</ul><div hidden>e</div><div role=banner>f</div>") == (["a", "b", "c", "d"], False)
    assert html_extraction.lines("<p>a</p><script>never closed <p>x</p>") == (["a"], False)


def test_html_differencing(spark):
    page = lambda own: f"<body><p>Site</p>{own}<p>Imprint</p></body>"
    data = [(1, "https://h.example/a/1", page("<p>first</p>")), (2, "https://h.example/a/2", page("<p>second</p><p>Site again</p>")), (3, "https://other.example/a/1", page("<p>alone</p>")), (4, None, None), (5, "https://h.example/a/3", ARTICLE), (6, "x", "")]
    df = spark.createDataFrame([(*r, "text", 1) for r in data], "page_id long, url string, html string, text string, n_chars int")
    got = rows(html_extraction.extract(df.coalesce(1)), "page_id")
    assert got[1].text == "first" and got[2].text == "second\nSite again" and got[3].text == "Site\nalone\nImprint"
    assert got[4].text == "" and got[5].text == "Head & more\nOne\nTwo three four" and got[6].n_chars == 0
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_html_differencing_of_copies_and_ranges(spark):
    page = lambda own: f"<body><p>Menu</p><p>{own}</p><p>Imprint</p></body>"
    data = [(k, "https://h.example/a/1", page("copied")) for k in range(5)]
    data += [(10 + k, f"https://h.example/b/{k:02}", page(f"own {k}")) for k in range(40)]
    data += [(60, "https://z.example/1", page("x")), (61, "https://z.example/2", page("y")), (62, None, page("none")), (63, None, page("none"))]
    expected = {r[0]: "copied" if r[0] < 5 else f"own {r[0] - 10}" for r in data if r[0] < 60} | {60: "x", 61: "y", 62: "Menu\nnone\nImprint", 63: "Menu\nnone\nImprint"}
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html_extraction.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(n)).collect()
            assert len(got) == len(data) and {r.page_id: r.text for r in got} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_html_differencing_of_marked_pages(spark):
    page = lambda own, nav, beside="": f"<body><nav><a>Home</a><p><a>{nav}</a></nav><article><h1><a>Weekly</a></h1>{own}<p>Shared words of both</p><ul><li><a>Share</a><li><a>Print</a></ul><p><a>The author</a></p><ol><li><a>Cited</a><li><a>{nav}</a></ol></article><p>{beside}</p></body>"
    data = [(1, "https://h.example/a/1", page("<p>A first text of its own, longer than what is shared", "One", "unmarked")), (2, "https://h.example/a/2", page("<p>Another text, again longer than what is shared", "Two"))]
    data += [(3, "https://copy.example/1", page("<p>A text", "One")), (4, "https://copy.example/2", page("<p>A text", "Two")), (5, "https://alone.example/1", page("<p>A text", "One"))]
    data += [(6, "https://mixed.example/1", page("<p>A text", "One", "Imprint")), (7, "https://mixed.example/2", "<body><p>own</p><p>Imprint</p></body>")]
    data += [(8, "x", "<p>a</p><p>Same</p>"), (9, None, "<p>b</p><p>Same</p>")]
    article = lambda own, nav, menu="": f"Weekly\n{own}\nShared words of both\n{menu}The author\nCited\n{nav}"
    expected = {1: article("A first text of its own, longer than what is shared", "One"), 2: article("Another text, again longer than what is shared", "Two")} | {k: article("A text", "Two" if k == 4 else "One", "Share\nPrint\n") for k in (3, 4, 5, 6)} | {7: "own", 8: "a", 9: "b"}
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = rows(html_extraction.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(n)), "page_id")
            assert {k: r.text for k, r in got.items()} == expected
            assert {k: (r.near_url, r.n_lines, r.n_shared) for k, r in got.items() if k in (1, 3, 5, 7, 8, 9)} == {1: ("https://h.example/a/2", 11, 7), 3: ("https://copy.example/2", 10, 8), 5: (None, 10, None), 7: ("https://mixed.example/1", 2, 1), 8: (None, 2, 1), 9: ("x", 2, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_html_differencing_of_many_equal_lines():
    a, b = ["x", "y"] * 8000, ["y", "x", "x"] * 6000
    assert len(html_extraction.common_lines(a, b)) >= 12000
    some, turned = list(range(6000)), [*range(3000, 6000), *range(3000)]
    assert len(html_extraction.common_lines(some, turned)) == 3000
    assert html_extraction.common_lines(a, ["z"] * 8000) == set() and len(html_extraction.common_lines(a, a)) == 16000


def test_common_lines():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html_extraction.common_lines(a, b))
        assert len(found) == table[-1][-1]
        it = iter(b)
        assert all(any(x == y for y in it) for x in (a[i] for i in found))


# 8


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    data += [(2000, None, 0), (2100, [0.0] * 24, 0), (2200, [float("nan")] * 24, 0), (2300, [1.0] * 23 + [None], 0), (2400, [1.0], 0), (2500, [], 0), (None, [1.0] * 24, 0), (1501, x[100].tolist(), 0), (1502, x[100].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    full, ids = np.concatenate([x, x[[100, 100]]]), np.arange(1502 + 1)
    ids = np.array([*range(1500), 1501, 1502])
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((full - full[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = [int(ids[i]) for i in np.lexsort((ids, d))[:10]]
        hits += len(set(best) & {v for v, _ in found})
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found)
    assert hits >= 0.9 * 150 and got[100][:2] == [(1501, 0.0), (1502, 0.0)]
    few = rows(ann.search(df.where("vec_id in (0, 1, 2)")), "rank")
    assert len(few) == 2 and ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id >= 2000")).count() == 0


def test_ann_probing_is_complete():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (400, 3), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 3, 7, 12, 24):
        distance = np.bitwise_count(codes ^ codes[5]).sum(axis=1)
        assert sorted(index.within(codes[5], radius)) == sorted(np.flatnonzero(distance <= radius))


# 9


def test_lm_scoring(spark, docs, empty):
    texts = corpus()
    got = rows(lm_scoring.score(docs))
    tokens = {i: (t or "").encode().lower().split() + ["END"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    one, two, three = Counter(), Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["BEGIN", *w[:-1]], w, strict=True))
            three.update(zip(["BEGIN", *w[:-2]], w[:-1], w[1:], strict=True) if len(w) > 1 else ())
    n, v = sum(one.values()), len(one)
    one["BEGIN"] = one["END"]
    k = lm_scoring.PRIOR
    p1 = lambda x: (one[x] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, x: (two[h, x] + k * p1(x)) / (one[h] + k)

    def p3(g, h, x):
        return (three[g, h, x] + k * p2(h, x)) / (two[g, h] + k) if g and two[g, h] >= lm_scoring.LEAST else p2(h, x)

    for i, w in tokens.items():
        s = sum(math.log10(p3(g, h, x)) for g, h, x in zip([None, "BEGIN", *w[:-2]], ["BEGIN", *w[:-1]], w, strict=False))
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(one[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10(p1(x)) for x in w), rel=1e-12) and got[i].score == pytest.approx(s, rel=1e-12)
    assert lm_scoring.score(empty).count() == 0


def test_lm_states_sum_to_one_and_failure_arcs_back_off():
    """By hand: words 0 and 1, the end 2; states 1, 2 (words), 4 (beginning), 5 (the pair 0 1)."""
    log = lambda *p: [math.log10(x) for x in p]
    (a, b, e), (ab,), (f1, f2) = log(0.5, 0.25, 0.25), log(0.9), log(0.2, 0.1)
    m = lm_scoring.Automaton(4, ([ab], [5]), ([-0.1], [1]), ([0, f1, f1, f1, f1, f2], [0, 0, 0, 0, 0, 2]), ([a, b, e], [1, 2, 3]))
    assert m.walk(4, [0, 1, 0], [-1, 0, -1], [-1, -1, 0]) == pytest.approx(f1 + a + ab - 0.1)
    assert m.walk(4, [0, 1, 2], [-1, 0, -1], [-1, -1, -1]) == pytest.approx(f1 + a + ab + f2 + f1 + e)


def test_lm_null_id(spark):
    got = lm_scoring.score(documents(spark, ["a b", None], [None, 3])).collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {None, 3}


# 10


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(mixing.KEEP * total, rel=0.01) or all(r.probability == 1 for r in got if r.tokens)
    assert all(0 <= r.probability <= 1 and r.sampled == (r.draw < r.probability) for r in got)
    assert mixing.mix(empty).count() == 0


def test_raking_holds_marginals():
    rng = np.random.default_rng(2)
    keys = [[str(x) for x in rng.integers(0, k, 200)] for k in (4, 3, 5)]
    tokens = rng.integers(1, 1000, 200).astype(float)
    wanted = []
    for k in keys:
        names = sorted(set(k))
        share = rng.random(len(names)) + 0.5
        wanted.append(dict(zip(names, share / share.sum(), strict=True)))
    cells = mixing.Numbers(keys, tokens)
    mixing.raked(cells, wanted)
    for axis, goal in enumerate(wanted):
        assert cells.shares(axis) == pytest.approx(goal, abs=1e-6)
    factor = mixing.calibrated(cells, tokens.sum(), 0.7)
    p = np.minimum(1, factor * cells.weight / tokens)
    assert (p * tokens).sum() == pytest.approx(0.7 * tokens.sum()) and (p == 1).any() and (p < 1).any()
    assert mixing.calibrated(cells, tokens.sum(), 0.0) == 0


def test_mixing_against_brute_force(spark, docs):
    """The query's rows by plain Python: cells, raking, calibration."""
    got = rows(mixing.mix(docs))
    cell = {}
    for i, t in enumerate(corpus()):
        words = len([w for w in (t or "").encode().split() if w])
        assert got[i].tokens == words and (got[i].source, got[i].lang) == (f"src{i % 3}", "en" if i % 2 else "")
        key = got[i].source, got[i].lang, got[i].topic
        cell[key] = cell.get(key, 0) + words
    cell = {k: float(x) for k, x in cell.items() if x}
    goals = []
    for axis in range(3):
        share = {}
        for k, x in cell.items():
            share[k[axis]] = share.get(k[axis], 0) + x
        share = {k: x**mixing.FLATTEN for k, x in share.items()}
        goals.append({k: x / sum(share.values()) for k, x in share.items()})
    w = {k: x / sum(cell.values()) for k, x in cell.items()}
    for _ in range(mixing.ROUNDS):
        worst = 0
        for axis in range(3):
            have = {}
            for k, x in w.items():
                have[k[axis]] = have.get(k[axis], 0) + x
            worst = max([worst, *(abs(have[k] - goals[axis][k]) for k in have)])
            w = {k: x * goals[axis][k[axis]] / have[k[axis]] for k, x in w.items()}
        if worst < mixing.TOLERANCE:
            break
    low, high = 0.0, 1e6
    for _ in range(300):
        factor = (low + high) / 2
        kept = sum(min(cell[k], factor * w[k]) for k in cell)
        low, high = (factor, high) if kept < mixing.KEEP * sum(cell.values()) else (low, factor)
    for r in got.values():
        key = r.source, r.lang, r.topic
        assert r.probability == pytest.approx(min(1, factor * w[key] / cell[key]) if key in cell else 1.0, rel=1e-9)


def test_mixing_by_table(spark, docs):
    by_driver = rows(mixing.mix(docs))
    by_table = rows(mixing.mix(docs, max_cells=0))
    for i, r in by_driver.items():
        assert by_table[i].probability == pytest.approx(r.probability, abs=1e-9) and by_table[i].sampled == r.sampled


def test_package_is_alone():
    """Nothing else in the library imports this subpackage."""
    from pathlib import Path

    top = Path(__file__).resolve().parents[2] / "corpusloom"
    for file in top.rglob("*.py"):
        if "llm" not in file.relative_to(top).parts:
            assert "corpusloom.llm" not in file.read_text()
