import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import text_queries
from weftline.llm.encode import SPLIT, TOKENIZERS, decode, encode, few_rows_a_batch, pieces
from weftline.llm.leaks import leaks, words
from weftline.llm.personal import find_personal, redact

DOCS = "doc_id bigint, text string, words string, block int, ids string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in enumerate(texts)], DOCS)


ODD = [
    None, "", " ", "\n\n  x\r\n\ty  ", "it's we'll they'RE 'd", "<|endoftext|> a<|endoftext|>", "naïve  Ünïcode ½ ² ٣٤ 漢字かな 👍🏽 é ​ \x85 　z \x00\x1f", "a" * 5000, "word " * 4000,
    "x" + " " * 300, "12345678901234567890", "‘quoted’ — dash…", "tab\t\ttab", "퟿�",
]


@pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no vocabulary files")
@pytest.mark.parametrize("block_chars", [50, 4_000_000])
def test_encode_and_decode(spark, block_chars):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = ODD + ["".join(r.choice(" \n'sdtaé9_-.字 ") for _ in range(r.randint(1, 60))) for _ in range(150)] + ["same text", "same text"]
    tok = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    df = docs(spark, texts).repartition(3)
    ids = encode(df, block_chars=block_chars).cache()
    got = {x.doc_id: list(x.ids) for x in ids.collect()}
    want = tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == {i: e.ids for i, e in enumerate(want)}
    back = {x.doc_id: x.text for x in decode(ids, pieces(spark)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.exists(TOKENIZERS), reason="no vocabulary files")
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encode_by_other_vocabularies(spark, name):
    r = random.Random(9)
    marks = ["a\u2581b \u2581", "A\u030angstr\u00f6m \u212b \u0130 \u03a3\u0399\u03a3", "  two  spaces\n\n \tand lines ", " \u3000 "]
    texts = ODD + marks + ["".join(r.choice(" \n'sdtaé9_-.字É ") for _ in range(r.randint(1, 60))) for _ in range(100)]
    path = f"{TOKENIZERS}/{name}"
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    elif name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts], num_threads=1)
    else:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        tok = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        want = [tok.encode_ordinary(t or "") for t in texts]
    got = {x.doc_id: list(x.ids) for x in encode(docs(spark, texts).repartition(3), path, block_chars=400, blocks_a_word=2).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != want[i]] == []


def test_small_batches_are_left_by_the_last_thread(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    one, two = few_rows_a_batch(spark, 7), few_rows_a_batch(spark, 9)
    one.__enter__()
    two.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(name) == "7"
    two.__exit__(None, None, None)
    assert spark.conf.get(name) == before


def test_encode_nothing(spark):
    assert encode(docs(spark, [])).count() == 0
    assert encode(docs(spark, [None, ""])).collect()[0].ids == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert encode(twice).count() == 3


def test_words():
    assert words("Don’t ＦＵＬＬ_width ½x İ ﬁne") == ["don", "t", "full", "width", "1", "2x", "i", "fine"]


def longest(doc, item):
    a, b = words(doc or ""), words(item or "")
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("probes", [4_000_000, 0])
def test_leaks(spark, probes):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(60)] + ["Äpfel", "ﬁsh", "x_y"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(5, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "a " * 20), (52, " ".join(vocab[:30])), (52, " ".join(vocab[:30]))]
    texts = [None, "", "x " * 3]
    for _ in range(60):
        t = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        src = r.choice([x for x in items if x[1]])[1].split()
        a = r.randrange(len(src))
        t[r.randint(0, len(t)) : 0] = src[a : a + r.randint(8, 20)]
        texts.append(r.choice([" ", ", ", "\n"]).join(t).upper() if r.random() < 0.3 else " ".join(t))
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, hashes string")
    got = leaks(docs(spark, texts), bench, probes_at_once=probes).collect()
    want = {(d, i) for d, t in enumerate(texts) for i, s in items if i is not None and longest(t, s) >= 13}
    assert {(x.doc_id, x.item_id) for x in got if x.n_exact >= 13} == want
    assert len(got) == len({(x.doc_id, x.item_id) for x in got})


def test_leaks_with_replaced_words(spark):
    item = " ".join(f"word{i}" for i in range(30))
    spoiled = item.split()
    for k in (9, 20):
        spoiled[k] = "other"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    x = leaks(docs(spark, ["before " + " ".join(spoiled) + " after", "nothing here"]), bench).collect()
    assert [(r.doc_id, r.n_exact, r.n_matched, r.n_span) for r in x] == [(0, 10, 28, 30)]
    assert leaks(docs(spark, []), bench).count() == 0 and leaks(docs(spark, [item]), bench.limit(0)).count() == 0


def test_leaks_of_long_items_far_from_their_hits(spark):
    item = [f"word{i}" for i in range(260)]
    spoiled = ["other" if 20 <= i < 240 and i % 3 == 0 else w for i, w in enumerate(item)]  # no window of the middle is a hit
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short " * 20)], "item_id bigint, text string")
    x = leaks(docs(spark, ["before " * 9 + " ".join(spoiled) + " after" * 9]), bench).collect()
    assert [(r.item_id, r.n_exact, r.n_matched, r.n_span) for r in x] == [(1, 22, 260 - spoiled.count("other"), 260)]


def test_leaks_of_a_long_item_replaced_word_by_word(spark):
    item = [f"word{i}" for i in range(400)]
    spoiled = [w if i < 20 or i % 4 else "other" for i, w in enumerate(item)]
    x = leaks(docs(spark, ["before " * 9 + " ".join(spoiled) + " after" * 9]), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r.n_matched, r.n_span) for r in x] == [(305, 400)]


@pytest.mark.parametrize("replaced,least", [(1, 1.0), (2, 0.99), (3, 0.95), (4, 0.9)])
def test_recall_of_passages_with_replaced_words(spark, replaced, least):
    r = random.Random(replaced)
    items = [[f"i{i}w{k}" for k in range(20)] for i in range(400)]
    texts = []
    for own in items:
        at = set(r.sample(range(20), replaced))
        texts.append("before " * r.randint(0, 5) + " ".join("other" if k in at else w for k, w in enumerate(own)) + " after" * r.randint(0, 5))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in leaks(docs(spark, texts), bench).collect()}
    assert got <= {(i, i) for i in range(400)} and len(got) >= least * 400


GIVEN, FAMILY = ["Anna", "Kenji", "Noor", "Zoë", "Mateo"], ["Ostdahl", "Quenimoto", "O'Ryssøya", "Veldwick", "Torrander", "Haskmoor"]


def corpus():
    r, truth, texts = random.Random(11), set(), []
    for i in range(120):
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        name = r.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} B. {f}", f"{g} {f}".upper()])
        plain = f.lower().replace("ø", "o").replace("'", "")
        mail = r.choice([f"{g.lower().replace('ë', 'e')}.{plain}@lab.example", f"{plain}+nb{i % 9} [at] k9.test", f"{plain} (at) post (dot) invalid"])
        phone = r.choice([f"+44 7700 900{i:03d}", f"030 23125 {i:03d}", f"(415) 555-0{i:03d}"])
        number = r.choice([f"{i:03d}-11-2233", f"{10000000 + i}-A", f"KR{i % 90 + 10}K{1000 + i}"])
        street = r.choice([f"{i + 1} Heron Road", f"Avenida Nardo, {i + 1}", f"{i + 1} bis, rue des Saulniers"])
        texts.append(f"# Data Cleaning {i}\nWritten by {name} for the office.\nCall {phone} if it dies.\nwrite to {mail}\nConsent on file: passport no. {number}, ok\nlives at {street} and asked\nlot no. 044-19-2207 and df@df.copy() 10.0.0.{i}\n")
        truth |= {(i, "person", name), (i, "phone", phone), (i, "email", mail), (i, "id_number", number), (i, "address", street)}
    return texts, truth


def test_personal(spark):
    texts, truth = corpus()
    parts = spark.createDataFrame([(x, "given") for x in GIVEN[:3]] + [(x.lower(), "family") for x in FAMILY[:4]] + [(None, "given"), ("Grace", None)], "name_part string, kind string")
    df = docs(spark, [*texts, None, "", " ", "A" * 5000])
    found = find_personal(df, parts).cache()
    got = {(x.doc_id, x.kind, x.pii_text) for x in found.collect()}
    assert got == truth
    clean = {x.doc_id: x.text for x in redact(df, found).collect()}
    for i, t in enumerate(texts):
        want = t
        for _, kind, s in sorted((x for x in truth if x[0] == i), key=lambda x: -len(x[2])):
            want = want.replace(s, f"[{kind.upper()}]")
        assert clean[i] == want
    assert clean[len(texts)] is None and clean[len(texts) + 1] == "" and clean[len(texts) + 3] == "A" * 5000


def test_forms_of_personal_information(spark):
    """Forms that none of the seeds has, in the places of known ones."""
    texts, truth = corpus()
    odd = {
        "person": ["Anna van Torrander", "Anna\xa0Veldwick", "Noor de la Veldwick", "Kenji Ostdahl Veldwick"], "phone": ["0171/1234567", "0171/7654321", "+44\xa07700\xa0900507", "030\u202f23125\u2011117"],
        "id_number": ["X1234567L", "C01234567", "QQ123456C"], "address": ["221B Heron Road", "12345 Heron Road", "12\xa0Heron\xa0Road", "ul. Heron Road 10"],
    }
    for kind, line in (("person", "Written by {} for the office.\n"), ("phone", "Call {} if it dies.\n"), ("id_number", "Consent on file: passport no. {}, ok\n"), ("address", "lives at {} and asked\n")):
        for s in odd[kind]:
            texts.append(f"# Odd {len(texts)}\n" + line.format(s))
            truth.add((len(texts) - 1, kind, s))
    texts.append("head\n" + "x" * 240 + "5550100anna.ostdahl@lab.example end, 75001 Paris on 12/10/2020 and 2020/10/2021")
    truth.add((len(texts) - 1, "email", "x" * 240 + "5550100anna.ostdahl@lab.example"))
    texts.append("# Odd\nAsk them ((415) 555-0188) or (030 23125 118) soon")
    truth |= {(len(texts) - 1, "phone", s) for s in ("(415) 555-0188", "030 23125 118")}
    parts = spark.createDataFrame([(x, "given") for x in GIVEN[:3]] + [(x.lower(), "family") for x in FAMILY[:4]], "name_part string, kind string")
    got = {(x.doc_id, x.kind, x.pii_text) for x in find_personal(docs(spark, texts), parts).collect()}
    assert got == truth


@pytest.mark.parametrize("share", [0.8, 0.6, 0.4])
def test_persons_by_a_part_of_the_names(spark, share):
    r = random.Random(21)
    vowels, given = "aeiou", []
    made = [a + b + c + d for a in "BDFGKLMN" for b in vowels for c in ("rst", "lv", "mm", "nd") for d in ("ik", "on", "el")]
    r.shuffle(made)
    given, family = made[:40], [m + "sson" for m in made[40:110]]
    lead = ["Written by {} for the office.", "Thanks to {} for help", "ask {} before you run this", "# Author: {}", "reviewed by {}, twice"]
    texts, truth = [], set()
    for i in range(600):
        name = f"{r.choice(given)} {r.choice(family)}"
        texts.append(f"# Data Cleaning {i}\n{r.choice(lead).format(name)}\nLoad The Data Frame and Plot It\n")
        truth.add((i, "person", name))
    full = [(x, "given") for x in given] + [(x, "family") for x in family]
    some = r.sample(full, int(share * len(full)))
    found = lambda parts: {(x.doc_id, x.kind, x.pii_text) for x in find_personal(docs(spark, texts), spark.createDataFrame(parts, "name_part string, kind string")).collect()}
    assert found(full) == truth
    got = found(some)
    assert got <= truth and len(got) >= 0.9 * len(truth)


def test_redacted_texts_without_an_id_of_their_own(spark, tmp_path):
    texts, truth = corpus()
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i for i in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    parts = spark.createDataFrame([(x, "given") for x in GIVEN[:3]] + [(x.lower(), "family") for x in FAMILY[:4]], "name_part string, kind string")
    parts.write.parquet(str(tmp_path / "name_parts.parquet"))
    want = []
    for i, t in enumerate(texts):
        for _, kind, s in sorted((x for x in truth if x[0] == i), key=lambda x: -len(x[2])):
            t = t.replace(s, f"[{kind.upper()}]")
        want.append((ids[i], t))
    got = [tuple(x) for x in text_queries.p8_redacted(spark, str(tmp_path)).select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bare = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, kind string, pii_text string, begin_at int, end_at int")
    assert sorted(map(tuple, redact(bare, none).collect()), key=repr) == [(1, "b"), (None, None)]


def test_personal_of_nothing(spark):
    none = spark.createDataFrame([], "name_part string, kind string")
    assert find_personal(docs(spark, []), none).count() == 0
    assert find_personal(docs(spark, ["Anna Ostdahl and nobody"]), none).count() == 0
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id bigint, text string")
    assert redact(twice, find_personal(twice, none)).withColumn("n", F.lit(1)).count() == 2
