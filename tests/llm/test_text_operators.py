"""Decontamination, tokenizers, token store, language ID, quality, chat, URL filter: against plain versions."""

import gc
import hashlib
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.llm import _shared, bpe, chat, decontaminate, langid, quality, token_store, url_filter
from docquarry.llm._shared import Scratch
from docquarry.llm.queries import tokenizer

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
ODD = ["", None, "   ", "!!", "a", "Hello  world\n\n it's 'll  <|endoftext|> x", "日本語 ½ ² é É İ ñ\x1c\x85 x", "word " * 3000, "x" * 5000, "a\n  b \t c  ", "😀 emoji's", "'S 'RE don'T"]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_contamination(texts, items):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            v = words(t)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == v[s : s + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_equals_plain_version(spark):
    rng = random.Random(1)
    vocabulary = ["Ab", "c1", "é", "dd", "e"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([3, 5, 13, 14, 20, 30])] + [(6, None), (7, "?!"), (5, "zz yy")]
    texts = [item(40) + ". " + rng.choice(items[:6])[1].upper() + ", " + item(10) for _ in range(20)] + [None, "", "...", item(2000)]
    got = decontaminate.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain_contamination(texts, items)


def test_contamination_in_blocks_and_spans(spark):
    text = "Before ONE two, three after"
    items = spark.createDataFrame([(1, "one two"), (2, "two three")], "item_id bigint, text string")
    docs = documents(spark, [text]).withColumn("scan", F.lit(1))
    for size in (10**6, 1):
        r = decontaminate.scan(docs, items, max_block_chars=size).first().scan
        assert [text[a:b] for a, b in r.spans] == ["ONE two, three"] and r["items"] == ["1", "2"]
    assert decontaminate.scan(docs, items.limit(0)).first().scan.n_words == 5
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns and decontaminate.drop_contaminated(docs, items).count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@pytest.fixture(scope="module")
def trie():
    return bpe.TrieBPE(tokenizer("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sahe")), max_size=40), max_size=5))
def test_bpe_equals_library(library, trie, texts):
    want = [e.ids for e in library["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False)]
    got = trie.encode_batch(texts)
    assert got == want
    assert [trie.decode(i) for i in got] == [library["byte_bpe_50k.json"].decode(i, skip_special_tokens=False) for i in want]


def test_bpe_query_equals_library(spark, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    lib = library["byte_bpe_50k.json"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.digests(documents(spark, texts).withColumn("ids", F.lit(1)), tokenizer("byte_bpe_50k.json")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    both = bpe.decode(bpe.encode(documents(spark, texts), tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r.decoded for r in both] == [t or "" for t in texts]


def test_small_tables_change_nothing(library):
    small = bpe.TrieBPE(tokenizer("byte_bpe_50k.json"), max_bytes=3000)
    rng = random.Random(8)
    for _ in range(60):
        text = " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randrange(1, 9))) for _ in range(30))
        assert small.encode_batch([text, "one two"]) == [library["byte_bpe_50k.json"].encode(t).ids for t in (text, "one two")]
        assert len(small.pairs) <= small.most + 1 and len(small.ends) <= small.most + 1 and len(small.words.now) + len(small.words.old) < 90


def odd_words(n, seed=5):
    """Distinct words of 1 to 40 bytes: syllables, any bytes' characters, numbers, signs, and words of one byte more or less than are walked together."""
    rng, out = random.Random(seed), {"a" * k for k in range(1, 41)} | {" " + "é" * k for k in range(1, 20)}
    while len(out) < n:
        kind = rng.randrange(4)
        alphabet = ("aeiou", "thensrdl", "".join(map(chr, range(0, 0x180))), "0123456789", "!?.-_\x00☃𝄞あ")[rng.randrange(5) if kind else 1]
        out.add(" " * rng.randrange(2) + "".join(rng.choice(alphabet) + ("" if kind else rng.choice("aeiou")) for _ in range(rng.randrange(1, 18))))
    return sorted(out)


@pytest.mark.parametrize("together", [20_000, 7])
def test_short_words_are_walked_together(library, monkeypatch, together):
    """Words of a batch, none of which goes through a call for each pair of tokens, have the library's ids."""
    monkeypatch.setattr(bpe, "TOGETHER", together, raising=False)
    calls, fits = [], bpe.TrieBPE.fits
    monkeypatch.setattr(bpe.TrieBPE, "fits", lambda *a: calls.append(a) or fits(*a))
    new, words = bpe.TrieBPE(tokenizer("byte_bpe_50k.json")), odd_words(3000)
    got = new.encode_batch(words)
    assert got == [e.ids for e in library["byte_bpe_50k.json"].encode_batch(words, add_special_tokens=False)]
    assert [new.decode(i) for i in got] == words
    short = [w for w in words if len(w.encode()) <= 32]
    calls.clear()
    assert new.walk(short) is None and not calls and len(short) > 2500


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sahe\x00")), max_size=12), min_size=1, max_size=8))
def test_walks_together_and_alone_agree(trie, texts):
    alone = trie.encode_batch(sorted(texts))
    trie.words.now, trie.words.old, trie.few = {}, {}, 0
    assert trie.encode_batch(sorted(texts)) == alone
    trie.words.now, trie.few = {}, 100


def test_ids_that_a_vocabulary_lacks(trie):
    assert trie.decode([]) == "" and len(trie.decode(trie.encode_batch(["a 1 ñ " * 40_000])[0])) == 240_000 and trie.listed(np.array([], np.int32)) == b"" and trie.listed(np.array([0, 50256])) == b"0,50256"
    for ids in ([-1], [60_000]):
        with pytest.raises(LookupError):
            trie.decode(ids)


def test_tokenizers_with_repeats_and_empty_tables(spark):
    path = tokenizer("byte_bpe_50k.json")
    docs = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2), (3, None, 2)], "doc_id bigint, text string, IDS int")
    got = bpe.digests(docs, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (3, 0), (3, 2), (3, 2)]
    assert bpe.digests(docs.limit(0), path).count() == 0
    assert bpe.encode(docs, path).columns == ["doc_id", "text", "ids"]
    store = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens) for r in token_store.round_trip(docs, tokenizer("word_bpe_49k.json")).collect()), key=lambda x: x[2])
    assert [x[1:] for x in store] == [(None, 0, 3), (3, 3, 1), (3, 4, 3), (3, 7, 3)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(1, 2**32 - 1))
def test_dac_reads_back(ids, top):
    ids = np.array([i % top for i in ids], np.uint32)
    reader = token_store.DacReader(token_store.dac_encode(ids))
    assert reader.slice(0, reader.n).tolist() == ids.tolist()
    for i in range(0, len(ids), 97):
        assert reader.access(i) == ids[i]
    if len(ids):
        assert reader.access(len(ids) - 1) == ids[-1] and reader.slice(len(ids) // 3, len(ids)).tolist() == ids[len(ids) // 3 :].tolist()
        with pytest.raises(IndexError):
            reader.access(len(ids))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'sahe.<|")), max_size=40), max_size=4))
def test_word_encoder_equals_library(library, texts):
    if not hasattr(test_word_encoder_equals_library, "encoder"):
        test_word_encoder_equals_library.encoder = token_store.WordEncoder(tokenizer("word_bpe_49k.json"), max_bytes=4000)
    want = [e.ids for e in library["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]
    ids, counts = test_word_encoder_equals_library.encoder.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == want and len(ids) == counts.sum()


def test_cut_words_are_encoded_without_being_cut_again(library):
    encoder, words = token_store.WordEncoder(tokenizer("word_bpe_49k.json")), ["don", "'s", "'", "7", "straße", "ɏéñ", "...", "_", "«", "('", "ªº", "x" * 90]
    one = [library["word_bpe_49k.json"].encode(w, add_special_tokens=False).ids for w in words]
    assert encoder.words.pre_tokenizer.pre_tokenize_str("don's")[0][1] == (0, 5)
    assert encoder._ids(" ".join(words), words=True).tolist() == [i for ids in one for i in ids]


def test_segments_of_any_size(spark):
    texts = ["word " * n for n in (3, 1, 0, 50, 2, 7)] * 20
    docs = documents(spark, texts)
    want = [(r.start, r.n_tokens, r.ids_crc32) for r in token_store.round_trip(docs, tokenizer("word_bpe_49k.json")).orderBy("doc_id").collect()]
    folder = f"{Scratch(spark, 'test').root}/files"
    token_store.write(docs, tokenizer("word_bpe_49k.json"), folder, segment_tokens=40)
    files = spark.read.parquet(folder)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(files).orderBy("doc_id").collect()] == want
    assert files.count() > 20 and files.where("n_tokens > 40 + 51").count() == 0


def test_token_store_query(spark, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs = documents(spark, texts).withColumn("payload", F.lit(1)).orderBy(F.rand(1))
    got, start = token_store.round_trip(docs, tokenizer("word_bpe_49k.json")).orderBy("doc_id").collect(), 0
    for r, t in zip(got, texts, strict=True):
        ids = [*library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32, r.first_id) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[0])
        start += len(ids)
    assert token_store.round_trip(docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    model = langid.fit(docs, F.lit(True), 200)
    odd = langid.predict(documents(spark, ["123 !!", None, "", "é", "x" * 200_000]).withColumn("score", F.lit("s")), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(r.score == 0 for r in odd[:3]) and all(0 <= r.score <= 1 for r in odd)
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_id_equals_plain_version(spark):
    """Counts, bits and decoding once more, text by text."""
    words = {"aa": "kala muna toki sina lipu", "bb": "strung werft dachs blitz", "cc": "oui eau ciel nuit"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(list(words) * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    asked = [" ".join(rng.choice(" ".join(words.values()).split()) for _ in range(6)) for _ in range(40)]
    model = langid.fit(docs, F.lit(True))
    got = [r.lang_pred for r in langid.predict(documents(spark, asked), model).orderBy("doc_id").collect()]

    bucket = lambda text: [(sum(ord(c) << 8 * (2 - k) for k, c in enumerate(f" {text} "[i : i + 3])) * 2654435761 % 2**32) >> 18 for i in range(len(text))]
    learned = [r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) != 4).collect()]
    counts = {lang: [0.5] * langid.BUCKETS for lang in words}
    for i, text, lang in rows:
        if i in learned:
            for b in bucket(text):
                counts[lang][b] += 1
    share = {lang: np.array(c) / sum(c) for lang, c in counts.items()}
    cuts = [({"aa"}, {"bb", "cc"}), ({"bb"}, {"aa", "cc"}), ({"cc"}, {"aa", "bb"})]
    right = 0
    for text, answer in zip(asked, got, strict=True):
        loss = dict.fromkeys(words, 0.0)
        for one, two in cuts:
            w = np.log(np.mean([share[x] for x in one], axis=0)) - np.log(np.mean([share[x] for x in two], axis=0))
            margin = sum(w[b] for b in bucket(text)) / len(bucket(text)) * min(64, len(bucket(text)))
            for lang in words:
                loss[lang] += np.logaddexp(0, -margin if lang in one else margin)
        right += min(loss, key=loss.get) == answer
    assert right == len(asked)  # every bit is right on the last fold, so all weigh alike


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "text here", None), (2, "more", None)], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {("und", 0.0)}


def test_every_language_is_learned(spark):
    """Many more languages than any real table has rows for: none is left out."""
    rng = random.Random(4)
    spell = lambda i: "".join(chr(97 + int(d) + 10 * (k % 2)) for k, d in enumerate(f"{i:03d}{i * 7 % 1000:03d}"))
    rows = [(i * 10 + k, " ".join(spell(i) + rng.choice("xyz") for _ in range(8)), f"l{i}") for i in range(700) for k in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), F.lit(True))
    assert len(model.languages) == 700 and len(model.code) == 700
    asked = [(f"l{i}", " ".join(spell(i) + rng.choice("xyz") for _ in range(8))) for i in range(0, 700, 7)]
    assert sum(model.predict(text)[0] == lang for lang, text in asked) >= 0.95 * len(asked)


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        apart = (code[:, None, :] != code[None, :, :]).sum(2)[~np.eye(n, dtype=bool)]
        assert apart.min() >= max(1, code.shape[1] // 4)


def plain_site_quality(rows, y, own):
    """Quality of (host, path) rows from labels or estimates y and own log odds, site by site."""
    n, mean = len(rows), sum(y) / len(rows)
    members = lambda key: {k: [i for i, r in enumerate(rows) if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths = members(lambda r: r[0]), members(lambda r: r)

    def strength(sites, parent):
        some = [(s, parent(k)) for k, s in sites.items() if len(s) > 1]
        total = sum(len(s) for s, _ in some)
        within = sum(len(s) * m * (1 - m) for s, m in some) / total
        spread = sum(len(s) * (sum(y[i] for i in s) / len(s) - m) ** 2 - m * (1 - m) for s, m in some) / total
        return min(max(within / max(spread, within / 10_000) - 1, 0.5), 10_000)

    host_mean = {h: sum(y[i] for i in s) / len(s) for h, s in hosts.items()}
    kh, kp = strength(hosts, lambda h: mean), strength(paths, lambda p: host_mean[p[0]])
    odds = lambda v: np.log(v / (1 - v))
    out = []
    for i in range(n):
        other = lambda s: sum(y[j] for j in s if j != i)  # noqa: B023, E731
        host = (other(hosts[rows[i][0]]) + kh * mean) / (len(hosts[rows[i][0]]) - 1 + kh)
        path = (other(paths[rows[i]]) + kp * host) / (len(paths[rows[i]]) - 1 + kp)
        out.append(0.0 if own[i] is None else 1 / (1 + np.exp(-(own[i] + odds(min(max(path, 1e-6), 1 - 1e-6)) - odds(mean)))))
    return out


def test_sites_equal_plain_version(spark):
    """The posteriors by brute force, on the classifier's own odds; the classifier itself is held to unseen labels below."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.orderBy("doc_id").collect()] + [(900 + i, t, "src0", "en") for i, t in enumerate(ODD)]
    every = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = quality.score(every, labels, F.col("source"), F.col("lang")).orderBy("doc_id").collect()
    known = {r.doc_id: float(r.quality) for r in labels.collect()}
    own = [None if not r.p_doc else np.log(r.p_doc / (1 - r.p_doc)) for r in got]
    y = [known.get(r.doc_id, r.p_doc) for r in got]
    want = plain_site_quality([(s, lang) for _, _, s, lang in rows], y, own)
    assert [r.quality for r in got] == pytest.approx(want, abs=1e-6)
    assert not got[200].keep  # the empty text


def test_quality_of_unseen_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score(docs, labels.where("doc_id % 5 <> 0"), F.col("source"), F.col("lang")).select("doc_id", "keep").join(labels.where("doc_id % 5 = 0"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in got}
    assert sum(r.n for r in got) > 600 and kept[1] > 0.98 and kept[0] < 0.1


def test_words_alone_tell_quality_apart(spark):
    """Texts alike on the surface: only which words they hold tells them apart."""
    rng = random.Random(9)
    good, bad = (["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)] for _ in range(2))
    texts = [" ".join(rng.choice((bad, good)[i % 2]) for _ in range(40)) for i in range(400)]
    docs = documents(spark, texts).withColumns({"source": F.lit("s"), "lang": F.lit("x")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    got = quality.score(docs, labels, F.col("source"), F.col("lang")).where("doc_id >= 300").collect()
    assert sum(r.keep == (r.doc_id % 2 == 1) for r in got) > 95


def test_quality_edge_cases(spark):
    docs = documents(spark, ODD).withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("x"), "keep": F.lit(1)})
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    kept = quality.keep_good(docs, none, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(ODD) if t and t.split()}
    assert quality.score(docs.limit(0), none, F.col("source"), F.col("lang")).count() == 0
    twice = spark.createDataFrame([(0, 0), (0, 1), (5, 1), (5, 1), (None, 0), (7, None), (4, 0)], "doc_id bigint, quality int")
    assert quality.score(docs.unionByName(docs), twice, F.col("source"), F.col("lang")).count() == 2 * len(ODD)


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "␛l ␛", "<s>", "", None, "[ROLE:x] y [/ROLE]", "a\nb", " [/SYS]"]
    roles = ["user", "assistant", "system", "tool]x", None, "assistant"]
    rows = [(c, t, roles[(c + t) % len(roles)], odd[(3 * c + t) % len(odd)]) for c in range(20) for t in range(c % 6 + 1)] + [(99, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("position", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.examples(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        mine = [(r or "", t or "") for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha("".join(f"{a}\n{b}\n" for a, b in mine)), len(loss), sha(loss))
    n_examples = chat.examples(df).where("conv_id = 5").count()
    assert n_examples == sum(r == "assistant" for i, _, r, _ in rows if i == 5) + (rows[[k for k, x in enumerate(rows) if x[0] == 5][-1]][2] != "assistant")
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_url_rules(spark):
    rules = [url_filter.host_path_rule(v, n) for v, n in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]
    urls = {
        "http://x.example.org/es/1": ("example.org/es/", "block"),
        "http://EXAMPLE.org/es": ("org/", "allow"),
        "http://example.org/en/19?q": ("example.org/en/1", "block"),
        "http://notexample.org/en/1": ("org/", "allow"),
        "http://org": (None, "allow"),
        "http://a.com/de/": ("com/de/", "block"),
        "http://a.com:80/de/": (None, "allow"),
        "http://a.com/DE/": (None, "allow"),
        "http://www.spam-farm.example.com/en": (None, "block"),
        "http://www.spam-farm.example.com/fr/x": ("com/fr/", "allow"),
        "no scheme": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
    }
    pages = spark.createDataFrame([(i % 5, u, "v") for i, u in enumerate([*urls, *urls])], "page_id int, url string, verdict string")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == 2 * len(urls) and {r.url: (r.rule, r.verdict) for r in got} == urls
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, [], ()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.judge(pages, [url_filter.Rule("any", ".", "block", ())])


def test_thousands_of_url_rules(spark):
    rng = random.Random(12)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)})
    rules = [url_filter.host_path_rule("block" if i % 2 else "allow", f"{h}.com/{'x/' if i % 3 else ''}") for i, h in enumerate(names)]
    patterns = tuple(url_filter.Rule(f"p {h}", rf"^{h}-shop\.", "block", (h, "shop")) for h in names[:1000])
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(names)}{rng.choice(['.com', '-shop.net'])}/{rng.choice(['x/1', 'y', ''])}" for _ in range(500)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id int, url string, __url int").withColumn("HOST", F.lit("h"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, patterns).collect()}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        fit = [(len(r.name), r.name, r.verdict) for r in rules if (host == r.name.split("/")[0] or host.endswith("." + r.name.split("/")[0])) and ("/" + path).startswith("/" + r.name.split("/", 1)[1])]
        own = any(host == f"{h}-shop.net" for h in names[:1000])
        assert got[i] == (max(fit)[1:] if fit else (None, "block" if own else "allow")), u
    assert url_filter.judge(pages, rules[:3], patterns[:3]).columns == ["page_id", "url", "__url", "host", "path", "rule", "verdict"]


def test_chat_edge_cases(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, 1, "user", "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("Position", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.examples(df)).collect()}
    want = "user\nfirst\nassistant\ny\nassistant\ny\nuser\nx\n"
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].loss_chars == 2 and got[None].n_turns == 2


def test_contamination_edge_cases(spark):
    docs = spark.createDataFrame([(1, "aa bb cc", 0), (1, "aa bb cc", 0), (None, None, 0), (2, "", 0)], "doc_id bigint, text string, SCAN int")
    items = spark.createDataFrame([(None, "bb"), (4, "aa bb"), (4, "aa bb")], "item_id bigint, text string")
    for size in (10**6, 1):
        rows = decontaminate.scan(docs, items, max_block_chars=size)
        assert rows.columns == ["doc_id", "text", "scan"]
        got = sorted((r.doc_id or 0, r.scan.n_words, tuple(map(tuple, r.scan.word_ranges)), tuple(r.scan["items"])) for r in rows.collect())
        assert got == [(0, 0, (), ()), (1, 3, ((0, 2),), ("4",)), (1, 3, ((0, 2),), ("4",)), (2, 0, (), ())]


def test_workers_let_go_of_what_other_stages_made(monkeypatch):
    monkeypatch.setattr(_shared, "_RESIDENT", {})
    monkeypatch.setattr(_shared, "_stage", lambda: 1)
    path = tokenizer("byte_bpe_50k.json")
    made = weakref.ref(bpe.encoder(path))
    list(_shared.slices(iter([])))  # another task of the stage
    assert made() is not None and made() is bpe.encoder(path)
    monkeypatch.setattr(_shared, "_stage", lambda: 2)
    list(_shared.slices(iter([])))
    gc.collect()
    assert made() is None


def test_texts_move_in_short_batches(spark):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long")
    short, long = (Scratch(spark, "batches").keep(sizes, "sizes", texts=texts) for texts in (True, False))
    assert [r.n for r in short.collect()] == [1000] * 5 and [r.n for r in long.collect()] == [5000]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
