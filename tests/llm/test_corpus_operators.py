"""The corpus operators against brute force, round trips, held-out accuracy and their defined edge cases."""

import functools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import chat, ctw, embedding_neighbors, fertility, licences, packing, pieces, pii, quality_votes, queries, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, bucket string"
LONG = "lorem ipsum dolor 4111 1111 1111 1111 " * 6000
TEXTS = ["", None, " ", "one", "x" * 50_000, LONG, "Ünïcödé ▁ text 😀 <|endoftext|> <|im_end|>", "same text twice here", "same text twice here", "a@b.co +1 (555) 123-4567 10.0.0.1", "\t\n mixed   space\r\n"]


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, "x", "y", "z") for i, t in enumerate(TEXTS)] + [(None, "a null id", None, None, None, None, None, None), (3, "one", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def groups(links, n):
    root = list(range(n))
    for i, j in links:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


OPERATORS = {
    "pii": pii.find_spans,
    "redact": pii.redact,
    "simhash": simhash.near_duplicates,
    "similar": simhash.similar_documents,
    "deduplicate": simhash.deduplicate,
    "encode": pieces.encode,
    "round_trip": pieces.round_trip,
    "ctw": ctw.score,
    "fertility": lambda d: fertility.judge(d, "doc_id"),
    "licences": licences.scan,
    "packing": packing.pack_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("deduplicate", "packing")])
def test_odd_rows_stay(odd, name):
    assert OPERATORS[name](odd).count() == len(TEXTS) + 2


@pytest.mark.parametrize("tile_bytes", [embedding_neighbors.TILE_BYTES, 3000])
def test_embedding_links_by_brute_force(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr(embedding_neighbors, "TILE_BYTES", tile_bytes)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    near = base[:30] + 0.12 * rng.normal(size=(30, 8))
    rows = [list(map(float, v)) for v in np.vstack([base, near, base[:5], base[:5] * 3])] + [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_neighbors.near_duplicates(df, block=16).collect()}
    m = np.array(rows[:100])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    links = [(i, j) for i in range(100) for j in range(i) if u[i] @ u[j] >= 0.95]
    degree, root = Counter(x for p in links for x in p), groups(links, 104)
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(104)] == [(degree[i], root[i], root[i] == i) for i in range(104)]
    assert embedding_neighbors.near_duplicates(df.limit(0)).count() == 0


def test_embedding_odd_rows(spark):
    base = [1.0, 2.0, 0.0, 0.0]
    edge = [0.95, math.sqrt(1 - 0.95**2), 0.0, 0.0]  # just at the threshold from the first axis
    rows = [(1, base), (1, base), (None, base), (2, [2.0, 4.0]), (3, [float("inf"), 1.0]), (4, []), (5, [1.0, 0.0, 0.0, 0.0]), (6, edge), (7, [-1.0, -2.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], "vec_id long, embedding array<double>, component_id string, n_links int")
    got = sorted((tuple(r) for r in embedding_neighbors.near_duplicates(df).collect()), key=str)
    cosine = np.dot(edge, [1.0, 0, 0, 0]) / np.linalg.norm(edge) >= 0.95
    linked = [(5, 1, 5, True), (6, 1, 5, False)] if cosine else [(5, 0, 5, True), (6, 0, 6, True)]
    # An id on two rows counts for each; a shorter vector is padded with zeros.
    wanted = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False), (3, 0, 3, True), (4, 0, 4, True), (7, 0, 7, True), *linked]
    assert got == sorted(wanted, key=str)


def test_far_clusters_never_meet(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * np.r_[np.full(6, 4.0), np.ones(18)]
    vectors = np.repeat(centres, 60, axis=0) + 0.02 * rng.normal(size=(2400, 24))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    classes = df.select("embedding", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"))
    axes = embedding_neighbors.principal_axes(classes, 24, embedding_neighbors.BOX_AXES)
    blocks, pairs = embedding_neighbors.block_pairs(classes, 24, 2400, axes, math.sqrt(0.1) + 1e-9, 32)
    n = blocks.count()
    assert n >= 40 and pairs.count() < 0.1 * n * (n + 1) / 2
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_neighbors.near_duplicates(df, block=32).collect()}
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i][0] for i in range(2400)] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i][1] == int(np.nonzero(near[i])[0][0]) for i in range(0, 2400, 60))


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := digits(m.group())) <= 19 and pii.luhn(d)]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_by_brute_force(spark):
    rng = random.Random(1)
    alphabet = "ab@..+-0123456789 () é\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)] + ["a@b@c.de", "x@y..z.com", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1+1234567890", "4111-1111 11111111", "😀 a.b@c.d 😀 +4930 1234567"]
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["spans"] if s["kind"] in pii.KINDS[: pii.CERTAIN]] for r in pii.find_spans(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_spans(t) for t in texts]


def test_context_and_checksums():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("ssn 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == []
    assert pii.redacted("mail a@b.co now") == "mail [EMAIL] now"


def test_fingerprints_by_brute_force(spark):
    import xxhash

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    texts = ["", None, "one two", *base, *[t.replace("w7", "W7", 1) for t in base], *[t + " end" for t in base]]

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for t in texts]
    root = groups([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], len(fps))
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(fps, root))


def test_large_buckets_and_planes():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, (70, 1), dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, (70, 1)).astype(np.uint64))
    i, j = simhash.block_links(a, b, 3)
    assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(70) for y in range(70) if int(a[x, 0] ^ b[y, 0]).bit_count() <= 3}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(4000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(20)]
    copies = [[*w[:150], "changed", *w[151:]] for w in base]
    kept = simhash.deduplicate(table(spark, [" ".join(w) for w in base + copies]))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_segmentation_by_brute_force():
    model = pieces.PieceModel(proto=as_unigram(given_proto(), zipf_scores()))
    rng = random.Random(6)
    for _ in range(60):
        part = " " + "".join(rng.choice("theinganös▁q😀") for _ in range(rng.randrange(1, 14)))
        text = part.replace(pieces.MARK, pieces._FOREIGN).replace(" ", pieces.MARK)
        best = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max([best[end - 1] + model.fallback, *(best[s] + model.pieces[text[s:end]][1] for s in range(end) if text[s:end] in model.pieces)])
        ids, _, score = model.segment(part)
        assert math.isclose(score, best[-1]) and model.decode(ids) == part[1:]


@functools.cache
def given_proto():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.default_path()).serialized_model_proto()


def zipf_scores():
    """Log-probabilities of the given model's pieces by their rank."""
    ranked = sorted(pieces.piece_model().pieces.values(), key=lambda x: -x[1])
    whole = math.fsum(1 / (r + 1000) for r in range(len(ranked)))
    return {i: -math.log((r + 1000) * whole) for r, (i, _) in enumerate(ranked)}


def as_unigram(proto, scores):
    """A SentencePiece model's bytes with other scores and the unigram type."""
    def varint(v):
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    out, i = b"", 0
    for field, value in pieces.proto_fields(proto):
        if field == 1:
            own = dict(pieces.proto_fields(value))
            value = b"\x0a" + varint(len(own[1])) + own[1] + b"\x15" + struct.pack("<f", scores.get(i, 0.0)) + (b"\x18" + varint(own[3]) if 3 in own else b"")
            i += 1
        elif field == 2:
            value += b"\x18\x01"  # the last type counts
        out += varint(field << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_scores_equal_the_librarys(spark):
    from sentencepiece import SentencePieceProcessor

    scores = zipf_scores()
    proto = as_unigram(given_proto(), scores)
    library, model = SentencePieceProcessor(model_proto=proto), pieces.PieceModel(proto=proto)
    assert pieces.model_type(proto) == 1 and model.pieces.keys() == pieces.piece_model().pieces.keys()
    n = same = 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        ids, _, score = model.encode(text or "")
        ids, theirs = np.frombuffer(ids, np.int32).tolist(), library.encode(text or "")
        n, same = n + 1, same + (ids == theirs)
        # Ties alone may be broken otherwise.
        assert math.isclose(score, sum(scores.get(i, model.fallback) for i in theirs), rel_tol=1e-6, abs_tol=1e-6) and len(ids) == len(theirs)
    assert same > 0.95 * n


def test_ids_are_the_given_models(spark):
    """Of every document, and of made-up texts, as the model's own encoder gives them."""
    from sentencepiece import SentencePieceProcessor

    library, model, rng = SentencePieceProcessor(model_proto=given_proto()), pieces.PieceModel(proto=given_proto()), random.Random(4)
    texts = [t or "" for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for letters in ("ab ", "aab", "  a\n\t", "theinganos .,", "01 =-_", "éü日本ñ😀 x", "lLoO0 ") for _ in range(300)]
    assert pieces.model_type(given_proto()) == 2
    for text in texts:
        assert np.frombuffer(model.encode(text)[0], np.int32).tolist() == library.encode(text)


def test_borders_are_those_of_the_merges():
    merges, rng = pieces.piece_model()._merges, random.Random(5)
    own = [p for p in merges.halves if p.isascii() and len(p) < 6]
    pairs = [(rng.choice(own), rng.choice(own)) for _ in range(4000)] + [(p, p) for p in own[:2000]]
    apart = [merges.apart(a, b) for a, b in pairs]
    assert apart == [merges.merged(a + b)[0] == [a, b] for a, b in pairs] and 0 < sum(apart) < len(pairs)


def test_models_that_change_texts_are_refused():
    proto = given_proto()
    assert pieces.refusal(proto) is None
    for settings in ("1201782000", "18002000", "2001", "20002800"):
        own = bytes.fromhex(settings)
        assert "normaliser" in pieces.refusal(proto + b"\x1a" + bytes([len(own)]) + own)


def test_all_texts_come_back(odd, spark):
    assert {r["restored"] for r in pieces.round_trip(odd).collect()} == {True}
    texts = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(odd.filter("doc_id is not null"))).collect()}
    assert all(texts[i] == (t or "") for i, t in enumerate(TEXTS))


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\\<\\|"), (1, 1, "assistant", "<|im_start|>x"), (2, 0, "assistant", None), (3, 0, None, "n"), (None, 0, "user", "u"), (4, 0, "us\ner\\n", "<\\\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).withColumn("loss_text", chat.loss_text()).collect()}
    assert [tuple(t) for t in out[1]["turns_read"]] == [("user", rows[0][3]), ("assistant", rows[1][3])]
    assert out[1]["loss_text"] == "<|im_start|>x" and out[1]["valid"] and not out[2]["valid"] and not out[3]["valid"]
    assert out[4]["turns_read"][0]["role"] == "us\ner\\n" and out[4]["turns_read"][0]["text"] == "<\\\\|" and out[1]["formatted"].count("<|im_end|>") == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def brute_ctw(train, text, depth):
    """log10 probability of a whole text by the plain recursion over contexts that run across words."""
    def steps(t):
        padded = b"\n" * depth + t
        for i in range(len(t)):
            for k in range(8):
                yield padded[i : i + depth], (t[i] >> (8 - k)) | (1 << k), t[i] >> (7 - k) & 1

    counts, below = {}, {}
    for t, is_train in [*((t, 1) for t in train), (text, 0)]:
        for context, node, bit in steps(t):
            for d in range(depth + 1):
                key = (context[depth - d :], node)
                counts.setdefault(key, [0, 0])[bit] += is_train
                if d:
                    below.setdefault((context[depth - d + 1 :], node), set()).add(key)
    log_kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    weights = {}

    def weighted(key):
        if key not in weights:
            own = log_kt(counts[key])
            if len(key[0]) < depth:
                children = sum(map(weighted, below[key]))
                top = max(own, children)
                own = top + math.log(math.exp(own - top) + math.exp(children - top)) - math.log(2)
            weights[key] = own
        return weights[key]

    def one(context, node, d=0):
        key = (context[depth - d :], node)
        n = counts[key]
        kt = (n[1] + 0.5) / (sum(n) + 1)
        if d == depth:
            return kt
        share = 1 / (1 + math.exp(min(700, sum(map(weighted, below[key])) - log_kt(n))))
        return share * kt + (1 - share) * one(context, node, d + 1)

    return sum(math.log10(p if bit else 1 - p) for context, node, bit in steps(text) for p in [one(context, node)])


@pytest.mark.parametrize("depth, options", [(2, {"parts": 3}), (5, {"parts": 4, "group_bytes": 40, "fan_in": 2}), (7, {})])
def test_context_tree_by_brute_force(spark, depth, options):
    texts = ["abra cadabra", "Abra  abba", "", None, "bab zz", "abra", "cad cab", "ba é", "abra cadabra", "the cat sat", "the hat", "a\u2028b", "tail\t"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 2**63 - 1, -(2**63), None, 11, 12]
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, score string").repartition(1)
    got = {(r["doc_id"]): r for r in ctw.score(df, depth=depth, **options).collect()}
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    words = [(t or "").lower().encode().split() for t in texts]
    flat = [b" ".join(w) + b"\n" for w in words]
    train = [t for t, h in zip(flat, held) if not h]
    tokens = [w for ws, h in zip(words, held) if not h for w in [*ws, b"\n"]]
    counts = Counter(tokens)
    assert len(got) == len(ids) and any(held)
    for i, ws, t, h in zip(ids, words, flat, held):
        base = sum(math.log10((counts[w] + 1) / (len(tokens) + len(counts) + 1)) for w in [*ws, b"\n"])
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (h, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, b"\n"]), len(tokens))
        assert math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert math.isclose(got[i]["score"], brute_ctw(train, t, depth), rel_tol=0, abs_tol=1e-6 * len(t))
        assert got[i]["n_bytes"] == len(t) and math.isclose(got[i]["bits_per_byte"], -got[i]["score"] / math.log10(2) / len(t))


def test_scores_without_training_text(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = ctw.score(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert (got["n_known"], got["train_tokens"]) == (0, 0) and math.isclose(got["score"], 5 * 8 * math.log10(0.5), rel_tol=1e-6) and math.isclose(got["bits_per_byte"], 8, rel_tol=1e-6)


def test_tree_beats_word_counts_on_held_out_texts(spark):
    found = queries.op6_ctw_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert found[2] > 100 and found[0] > found[1]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op7_quality_votes(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = found.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("quality")).cast("double").alias("r")).agg(F.avg("r"), F.count("*")).first()
    assert right[1] > 50 and right[0] >= 0.9


def plain_votes(texts, sample, labels, model, k):
    """Scores by the rule written out: each text against each labelled vector, ties at the k-th cosine included."""
    places, out = quality_votes._Places(), []
    project = lambda v: (lambda p: p / max(np.linalg.norm(p), 1e-12))((v * model.rarity) @ model.axes)
    known = [project(v) for v in sample]
    for t in texts:
        raw = quality_votes.features((t or "").encode().split(), places)
        if not raw.any():
            out.append(0.0)
            continue
        cosines = [max(0.0, float(project(raw) @ v)) for v in known]
        least = sorted(cosines)[-min(k, len(cosines))]
        near = [(c**quality_votes.SHARPNESS, y) for c, y in zip(cosines, labels) if c >= least - 1e-6]
        out.append(sum(w * y for w, y in near) / sum(w for w, _ in near))
    return out


def test_votes_by_brute_force(spark):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "me", "ni", "po", "ru")]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(20, 60)))
    bad = lambda: " ".join([rng.choice(words).upper() + "!!"] * rng.randrange(5, 40))
    texts = [good() if i % 3 else bad() for i in range(150)] + ["", None, "word " * 60_000]
    ids = list(range(len(texts)))
    labels = [(i, int(i % 3 > 0)) for i in range(0, 100)] + [(1, 1), (1, 1), (2, 0), (4, None), (5, 7)]  # repeated, contradicting, null and unknown ones
    docs = table(spark, texts)
    model = quality_votes.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    used = sorted((i, y) for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1)
    assert sorted(model.labels.tolist()) == sorted(float(y) for _, y in used)
    sample = [quality_votes.features((texts[i] or "").encode().split(), quality_votes._Places()) for i, _ in used]
    got = {r["doc_id"]: r["score"] for r in quality_votes.classify(docs, model, "doc_id").collect()}
    wanted = plain_votes(texts, sample, [y for _, y in used], model, quality_votes.NEIGHBOURS)
    assert np.allclose([got[i] for i in ids], wanted, atol=1e-3) and {round(got[i]) for i in range(100, 150)} == {0, 1}


def test_quality_without_labels(spark, odd):
    model = quality_votes.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in quality_votes.classify(odd, model, "doc_id").collect()} == {0.5}


def junk_and_clean(rng):
    """Clean texts of a vocabulary of skewed use, and one faulty text for each band."""
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    clean = [" ".join(rng.choices(words, [1 / (i + 3) for i in range(300)], k=rng.randrange(90, 130))) for _ in range(140)]
    symbols = " ".join("".join(rng.choice("^~`qxzj7") for _ in range(7)) for _ in range(100))
    foreign = " ".join([rng.choice("information people because different through another between important government development company general".split()) for _ in range(90)] + ["𐌰𐌱"] * 12)
    poor = " ".join(rng.choice("no so go to do we me he be by my at in on is it".split()) for _ in range(120))
    return clean, {"chars_per_token": symbols, "byte_share": foreign, "token_entropy": poor}


def plain_judgements(rows):
    """(kept, reason) of each (text, lang): the rules written out, with no Spark."""
    one, two = fertility.word_tokens(fertility.default_path()), fertility.word_tokens(fertility.second_path())
    seen = []
    for text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        chars = sum(map(len, words))
        win = Counter(zip(words, words[1:], words[2:]))
        rep = len({k for j in range(len(words) - 2) if win[tuple(words[j : j + 3])] > 1 for k in (j, j + 1, j + 2)})
        ids = [[int(i) for w in words for i in v.of([[w.encode()]])[0]] for v in (one, two)]
        bits = [-sum(c / len(x) * math.log2(c / len(x)) for c in Counter(x).values()) if x else 0.0 for x in ids]
        per = [chars / len(x) if x else 0.0 for x in ids]
        least, most, byte_most, bits_least = fertility.BANDS[fertility.script_of(text)]
        share = sum(bool(one.is_byte[i]) for i in ids[0]) / max(1, len(ids[0]))
        base = len(words) < 50 or 100 * rep > 50 * len(words)
        reason = "base" if base else "chars_per_token" if not least <= per[0] <= most else "byte_share" if share > byte_most else "token_entropy" if bits[0] < bits_least else None
        seen.append(((lang or fertility.script_of(text), int(math.log2(max(1, len(ids[0]))))), (per[0], bits[0], per[1], bits[1]), base, reason))
    out = []
    for group, measures, base, reason in seen:
        peers = sorted({m for g, m, b, _ in seen if g == group and not b})
        if reason is None and len(peers) >= fertility.MIN_TEXTS:
            for k, name in enumerate(("chars_per_token", "token_entropy") * 2):
                column = sorted(m[k] for m in peers)
                q1, q2, q3 = (column[math.ceil(p * len(column)) - 1] for p in (0.25, 0.5, 0.75))
                reach = 4 * max((q3 - q1) / 1.349, 0.015 * q2)
                if not q2 - reach <= measures[k] <= q2 + reach:
                    reason = reason or name
        out.append((reason is None, reason))
    return out


def test_fertility_verdicts_by_brute_force(spark):
    rng = random.Random(9)
    clean, junk = junk_and_clean(rng)
    rows = [(t, ["en", None][i % 2]) for i, t in enumerate(clean)] + [(t, "en") for t in junk.values()] + [(clean[3], None), ("short text", "xx"), ("", None)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["kept"], r["reason"]) for r in fertility.judge(df, "doc_id").collect()}
    wanted = plain_judgements(rows)
    assert [got[i] for i in range(len(rows))] == wanted
    assert [r for _, r in wanted[len(clean) : len(clean) + 3]] == list(junk) and sum(k for k, _ in wanted[: len(clean)]) >= 0.97 * len(clean)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_fertility_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    kept = dict(found.groupBy("quality").agg(F.avg(F.col("kept").cast("double"))).collect())
    assert kept[1] >= 0.97 and kept[0] <= 0.4


def test_counts_by_brute_force(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a ", "b ", "c#d ", "\n", "é\t", "a b a b "]) for _ in range(rng.randrange(120))) for _ in range(60)]
    got = {r["doc_id"]: r for r in fertility.judge(table(spark, texts), "doc_id").collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        win = Counter(zip(w, w[1:], w[2:]))
        rep = len({k for j in range(len(w) - 2) if win[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)})
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep)
        assert r["base_failed"] == (len(w) < 50 or 100 * rep > 50 * len(w)) and (not r["kept"] or not r["base_failed"])


def test_licences(spark):
    texts = ["Released under the MIT License.", "Some text.\nLicensed under the Apache License,\nVersion 2.0. More", "SPDX-License-Identifier: GPL-3.0-or-later", "nothing", None, ""]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(table(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == [["MIT"], ["Apache-2.0"], ["GPL-3.0-or-later"], [], [], []]


@pytest.mark.parametrize("control", [False, True])
def test_packing(spark, odd, control):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = packing.pack_pieces(packing.cut_pieces(odd, 64, control=control), 64, group_items=40).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(bins) <= math.ceil(sum(r["length"] for r in out) / 64) * 1.02 + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = not control
    assert len(tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids) == 1 or not control
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cut = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == i and (i != 3)})
        for piece, start, length, crc in cut:
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc and (piece == 0 or length == 64)
        assert i == 3 or sum(c[2] for c in cut) == len(ids)


def plain_best_fit(sizes, capacity):
    """Best-fit decreasing by a search of all bins."""
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = [b for b in bins if capacity - sum(sizes[j] for j in b) >= sizes[i]]
        if fitting:
            min(fitting, key=lambda b: capacity - sum(sizes[j] for j in b)).append(i)
        else:
            bins.append([i])
    return bins


def test_best_fit_by_brute_force(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 60, 150):
        sizes = [rng.choice([1, 7, 33, 50, 64, rng.randrange(1, 65)]) for _ in range(n)]
        mine, plain = packing.best_fit(sizes, 64), plain_best_fit(sizes, 64)
        assert sorted(i for b in mine for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 64 for b in mine)
        assert sorted(sum(sizes[i] for i in b) for b in mine) == sorted(sum(sizes[i] for i in b) for b in plain)
    # One group packs as the plain rule does, and many groups with merged residues nearly as well.
    sizes = [rng.randrange(1, 65) for _ in range(900)]
    pieces_of = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], packing.PIECES)
    count = lambda **o: packing.pack_pieces(pieces_of, 64, **o).select("sequence_id").distinct().count()
    least = len(plain_best_fit(sizes, 64))
    assert count() == least and least <= count(group_items=90) <= 1.03 * least + 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, out = docs.columns, corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names


def at_similarity(tag, similarity, n=300):
    """Two texts of about n different shingles each with about the similarity: one has a tail of its own."""
    shared = round(n * 2 * similarity / (1 + similarity))
    words = [[f"{tag}{side}{i}" for i in range(n - shared)] for side in "xy"]
    base = [f"{tag}s{i}" for i in range(shared + 4)]
    return [" ".join(base + own) for own in words]


def exact_jaccard(s, t, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (s.split(), t.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_links_are_exact_similarities(spark):
    pairs = [at_similarity(f"p{i}q", s) for i, s in enumerate([0.70, 0.75, 0.78, 0.80, 0.803, 0.85] * 12)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, [t for p in pairs for t in p])).collect()}
    near = [exact_jaccard(*p) >= 0.8 for p in pairs]
    assert 12 < sum(near) < 60
    assert [got[2 * i + 1] == got[2 * i] for i in range(len(pairs))] == near


def test_large_groups_are_searched_whole(spark):
    # One template with different middles: below the threshold for all pairs but those with equal middles and other ends.
    base, texts = [f"b{i}" for i in range(240)], []
    for i in range(70):
        middle = [f"m{i // 2}x{j}" for j in range(40)]
        texts.append(" ".join([*base, *middle, f"end{i}"]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, texts)).collect()}
    root = groups([(i, j) for i in range(70) for j in range(i) if exact_jaccard(texts[i], texts[j]) >= 0.8], 70)
    assert [got[i] for i in range(70)] == root and len(set(root)) == 35


def test_repeats_count_once(spark):
    passage = " ".join(f"s{i}" for i in range(24))
    shared = [" ".join([*[passage] * 10, *(f"{side}{i}" for i in range(200))]) for side in "xy"]
    body = " ".join(f"z{i}" for i in range(260))
    same = [f"{body} {' '.join([passage] * n)}" for n in (1, 12)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, [*shared, *same])).collect()}
    assert [got[i] for i in range(4)] == [0, 1, 2, 2]


def test_ibans_before_words():
    texts = {"ES91 2100 0418 4502 0005 1332 EUR 50": "[IBAN] EUR 50", "BE68 5390 0754 7034 BIC": "[IBAN] BIC", "BE68 5390 0754 7034 BANK CODE 12": "[IBAN] BANK CODE 12", "AB13 3456 7890 BE68 5390 0754 7034": "AB13 3456 7890 [IBAN]", "BE68 5390 0754 7035 BIC": "BE68 5390 0754 7035 BIC"}
    assert {t: pii.redacted(t) for t in texts} == texts


def test_long_and_dotted_secrets():
    part = lambda n: ("Ab3dE9xQ7z_k" * n)[: 12 * n]
    assert pii.redacted(f"token {part(60)} end") == "token [SECRET] end"
    assert pii.redacted(f"bearer {part(3)}.{part(80)}.{part(4)}") == "bearer [SECRET].[SECRET].[SECRET]"
    assert pii.redacted(f"name {part(60)} end") == f"name {part(60)} end"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_wrapped_licences(spark):
    import textwrap

    wrap = lambda t: "\n\n".join(textwrap.fill(p, 70) for p in t.split("\n\n"))
    head = "Copyright (c) 2020 A. Person\n"
    notices = "\n".join(["Released under the MIT License"] * 5)
    texts = [f"{head}\n{wrap(MIT)}", head + wrap(ISC), f"{head}\n{wrap(BSD)}", wrap(MPL), f"{notices}\n\n{wrap(ISC)}", wrap(MPL.replace("v. 2.0", "v.\n2.0"))]
    got = {r["doc_id"]: r for r in licences.scan(table(spark, texts)).collect()}
    assert [got[i]["licences"] for i in range(6)] == [["MIT"], ["ISC"], ["BSD-3-Clause"], ["MPL-2.0"], ["MIT", "ISC"], ["MPL-2.0"]]
    assert got[0]["sentence_ids"] == ["mit-grant", "mit-condition"] and got[2]["n_unmatched"] == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, script string, reason string, n_words long, _score double, _kept boolean, dropped_id long, component_id long, band_group string, spans string"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, 1, 0.1, False, "s", "r", 2, 0.2, False, 3, 4, "g", "p") for i, t in enumerate(texts)] + [(None, "a null id", *[None] * 14)], CLASH)


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    import corpus_pipeline

    docs = clashing(spark, TEXTS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r["n_words"] for r in out.collect()} <= {2, None}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.best_fit_packing(spark, docs, SF).count() >= len(TEXTS) + 1


def test_context_moves_scores_both_ways():
    scores = lambda t: {s[0]: s[3] for s in pii.spans_of(t)}
    assert scores("call +49 30 1234567 now")["phone"] > scores("it is +49 30 1234567 now")["phone"] > scores("serial +49 30 1234567 now")["phone"] >= pii.THRESHOLD
    assert "iban" in scores("GB82 WEST 1234 5698 7654 32") and "iban" not in scores("serial GB82 WEST 1234 5698 7654 32") and "iban" in scores("iban, serial GB82 WEST 1234 5698 7654 32")
    assert "ssn" in scores("ssn 123-45-6789") and "ssn" not in scores("ssn, or part 123-45-6789")


def test_very_long_secret(spark):
    key = "Ab3dE9xQ7z_k" * 8334
    assert pii.redacted(f"api key {key} end") == "api key [SECRET] end"
    many = " ".join(["+1 (555) 123-4567"] * 3000)
    assert sum(s[0] == "phone" for s in pii.spans_of(many)) == 3000


def test_recall_by_similarity_and_length(spark):
    rows, near = [], {}
    for n in (12, 40, 150, 600):
        for similarity in (0.82, 0.88, 0.95):
            for k in range(12):
                pair = at_similarity(f"r{n}q{int(similarity * 100)}z{k}y", similarity, n)
                near[len(rows)] = (n, exact_jaccard(*pair) >= 0.8)
                rows += pair
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table(spark, rows)).collect()}
    for n in (12, 40, 150, 600):
        wanted = [i for i, (m, is_near) in near.items() if m == n and is_near]
        assert sum(got[i + 1] == got[i] for i in wanted) >= 0.97 * len(wanted) and len(wanted) >= 24
    assert all(got[i + 1] != got[i] for i, (_, is_near) in near.items() if not is_near)


GNU = """This {it} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{comma} either version {v} of the License, or (at your option) any later version.

This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
CC0 = "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."
MIT_END = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_public_licence_texts(spark):
    import textwrap

    import duckdb

    wrap = lambda t: "\n\n".join(textwrap.fill(p, 66) for p in t.split("\n\n"))
    wanted = {
        GNU.format(it="program", mark=":", name="", comma=",", v="3"): "GPL-3.0-or-later",
        GNU.format(it="program", mark=";", name="", comma=";", v="2"): "GPL-2.0-or-later",
        GNU.format(it="library", mark=";", name="Lesser ", comma=";", v="2.1"): "LGPL-2.1-or-later",
        GNU.format(it="library", mark=":", name="Lesser ", comma=",", v="3"): "LGPL-3.0-or-later",
        GNU.format(it="program", mark=":", name="Affero ", comma=",", v="3"): "AGPL-3.0-or-later",
        APACHE: "Apache-2.0",
        ZLIB: "Zlib",
        EPL: "EPL-2.0",
        CC0: "CC0-1.0",
        MIT + MIT_END: "MIT",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        **{f"// SPDX-License-Identifier: {name}\ncode": name for name in licences.SPDX},
    }
    texts = [t for text in wanted for t in (text, wrap(text), f"Some prose before. {text}\n\nAnd after it; the end")]
    texts += [None, "", "MIT", "the MIT licence", "permission is hereby granted", "\x01mit license\x02", "a.MIT License.b", "Mit\r\nLicense\r\n", "MIT License. " * 2000]
    got = {r["doc_id"]: r for r in licences.scan(table(spark, texts)).collect()}
    names = list(wanted.values())
    for i, text in enumerate(texts[: 3 * len(names)]):
        if not (i % 3 and "SPDX" in text):  # more text in an identifier's line makes another sentence of it
            assert got[i]["licences"] == [names[i // 3]], text
    assert got[0]["n_unmatched"] == 0 and got[len(texts) - 1]["n_matches"] == 2000
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(queries.oracle_sql()["op9_licence_scan"]).fetchall()
    join = ",".join
    assert {r[0]: r[1:] for r in rows} == {i: (join(r["sentence_ids"]), join(r["licences"]), join(r["classes"]), r["n_matches"], r["n_unmatched"]) for i, r in got.items()}
