import random
import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import key_queries
from weftline.llm.event_runs import collapse_runs
from weftline.llm.seen_keys import Sealed, SeenKeys, answer_errors, mix, seen_before
from weftline.llm.shared_spans import SpanIndex, WaveletMatrix, shared_spans
from weftline.llm.term_counts import RECORDS, TermCounts, count_terms, mark_terms, record_terms, signed_deltas
from weftline.shared import fresh_path


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


KMER = "seq_id bigint, kmer_key bigint, kmer_offset int, is_reverse int, batch_no int, n_records string"


def kmers(r, n):
    out = [(r.randint(1, 9), r.choice([None, 1, 1, 1, 2, 3, 4, 5]), r.randint(0, 12), r.randint(0, 1), r.choice([None, 0, 1, 2, 3, 4]), "clash") for _ in range(n)]
    return out + out[:10] + [(None, 3, 1, 0, 1, "x"), (20, 77, 3, 0, 4, "x")]


def count_by_hand(data):
    want = {}
    for name, k in (("kmer_key", 1), ("kmer_offset", 2)):
        for v in {d[k] for d in data} - {None}:
            own = {(d[0], d[2], d[3]) for d in data if d[k] == v and d[0] is not None}
            if own:
                want[name, v] = (len(own), len({o[0] for o in own}))
    return want


def test_term_counts_of_batches(spark):
    data = kmers(random.Random(1), 300)
    store = count_terms(spark, frame(spark, data, KMER), "seq_id", ["kmer_offset", "is_reverse"], ["kmer_key", "kmer_offset"], "batch_no", fresh_path(spark, "t"), bucket_terms=3)
    got = {(x.field_name, x.field_value): (x.n_occurrences, x.n_records) for x in store.counts().collect()}
    n = len({d[0] for d in data} - {None})
    assert got.pop((RECORDS, 0)) == (n, n) and store.records() == n
    assert got == count_by_hand(data)


def test_term_counts_of_changed_and_deleted_records(spark):
    place, fields = ["kmer_offset", "is_reverse"], ["kmer_key", "kmer_offset"]
    data = kmers(random.Random(2), 200)
    path = fresh_path(spark, "t")
    TermCounts(spark, path, 3).apply(record_terms(frame(spark, data, KMER), "seq_id", place, fields))
    store = TermCounts(spark, path, 3)
    # record 1 goes, record 2 gets other rows, record 50 comes
    fresh = [(2, 5, 40, 0, 9, "x"), (2, 5, 41, 0, 9, "x"), (50, 5, 1, 1, 9, "x")]
    before = [d for d in data if d[0] in (1, 2, 50)]
    store.apply(signed_deltas(frame(spark, before, KMER), frame(spark, fresh, KMER), "seq_id", place, fields))
    now = [d for d in data if d[0] not in (1, 2)] + fresh
    got = {(x.field_name, x.field_value): (x.n_occurrences, x.n_records) for x in store.counts().collect()}
    assert got.pop((RECORDS, 0))[0] == len({d[0] for d in now} - {None})
    assert got == count_by_hand(now)


def test_term_counts_are_kept_and_changed_bucket_by_bucket(spark, tmp_path):
    place, fields = ["kmer_offset", "is_reverse"], ["kmer_key"]
    path = str(tmp_path / "terms")
    data = [(s, 100 + k, k, 0, 0, "x") for s in range(4) for k in range(60)]
    TermCounts(spark, path, 4).apply(record_terms(frame(spark, data, KMER), "seq_id", place, fields))
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "terms" / "terms").rglob("*.parquet")}
    before = files()
    folders = {r.bucket: r.folder for r in TermCounts(spark, path, 4)._manifest()}
    assert len(folders) >= 16 and len(before) == len([f for f in folders.values() if f])
    # another session: a record comes, one is changed, one goes; two terms and the number of records are touched
    fresh = [(0, 100 + k, k, 0, 1, "x") for k in range(60) if k != 5] + [(9, 107, 1, 1, 1, "x")]
    old = [d for d in data if d[0] == 0]
    TermCounts(spark.newSession(), path, 4).apply(signed_deltas(frame(spark, old, KMER), frame(spark, fresh, KMER), "seq_id", place, fields))
    now = {r.bucket: r.folder for r in TermCounts(spark, path, 4)._manifest()}
    changed = {b for b in now if now[b] != folders[b]}
    assert 0 < len(changed) <= 3 and {f: t for f, t in files().items() if f in before} == before
    assert len(files()) == len(before) + len([b for b in changed if now[b]])
    store = TermCounts(spark, path, 4)
    got = {(x.field_name, x.field_value): (x.n_occurrences, x.n_records) for x in store.counts().collect()}
    want = count_by_hand([d for d in data if d[0]] + fresh)
    assert got.pop((RECORDS, 0))[0] == 5 and got == {k: v for k, v in want.items() if k[0] == "kmer_key"}
    # all records go: every term leaves, and terms that come back are counted from nothing
    rest = [d for d in data if d[0]] + fresh
    store.apply(signed_deltas(frame(spark, rest, KMER), frame(spark, [], KMER), "seq_id", place, fields))
    assert store.counts().count() == 0 and store.records() == 0
    store.apply(record_terms(frame(spark, data[:3], KMER), "seq_id", place, fields))
    assert TermCounts(spark, path).counts().count() == 4


def test_terms_of_nothing_and_marks(spark):
    empty = frame(spark, [], KMER)
    store = count_terms(spark, empty, "seq_id", ["kmer_offset", "is_reverse"], ["kmer_key"], "batch_no", fresh_path(spark, "t"))
    assert store.counts().count() == 0 and store.records() == 0
    counts = frame(spark, [("f", 1, 2, 2), ("f", 2, 3, 1), ("f", 3, 9, 2), ("*", 0, 9, 9)], "field_name string, field_value bigint, n_occurrences bigint, n_records bigint")
    got = rows(mark_terms(counts, 9, 3, 0.2).select("field_value", "mark"))
    assert got == [(1, "common"), (1, "rare"), (2, None), (3, "common")]


def chains(data, tolerance, gap):
    out = []
    for e in sorted({d[0] for d in data if d[0] is not None}):
        own = sorted({(o, -1 if b is None or v is None else b, 0 if b is None or v is None else v) for x, o, b, v in data if x == e and o is not None})
        run = []
        for k, (o, b, v) in enumerate(own):
            if run and b != -1 and run[-1][1] == b and abs(run[-1][2] - v) <= tolerance and (gap is None or o - run[-1][0] <= gap):
                run.append((o, b, v))
            else:
                if len(run) > 1:
                    out.append((e, run[0][0], run[-1][0], len(run), o - run[0][0]))
                run = [(o, b, v)]
        if len(run) > 1:
            out.append((e, run[0][0], run[-1][0], len(run), None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,partitions,gap", [(1, 1, None), (2, 7, None), (3, 40, 3), (4, 13, 2)])
def test_event_runs(spark, seed, partitions, gap):
    r = random.Random(seed)
    data = [(1 if r.random() < 0.7 else r.randint(2, 4), r.randint(0, 400), r.choice([None, 7, 7, 7, 7, 8]), r.choice([0, 1, 2, 3, None])) for _ in range(500)]
    data = list({(d[0], d[1]): d for d in data}.values())
    data += data[:30] + [(None, 1, 7, 0), (1, None, 7, 0)]
    df = frame(spark, data, "file_id bigint, s bigint, b bigint, v bigint").withColumn("entity", F.lit("clash")).withColumn("n", F.lit(0))
    got = collapse_runs(df, "file_id", "s", F.col("b"), F.col("v"), 1, gap, partitions)
    assert rows(got) == chains(data, 1, gap)


def test_one_long_run_over_many_tasks_and_no_events(spark):
    df = spark.range(5000).select(F.lit(1).alias("e"), "id", F.lit(3).alias("b"), F.lit(0).alias("v"))
    assert rows(collapse_runs(df, "e", "id", F.col("b"), F.col("v"), 2, partitions=9)) == [(1, 0, 4999, 5000, None)]
    assert collapse_runs(df.limit(0), "e", "id", F.col("b"), F.col("v"), 2).count() == 0


def test_sealed_keys():
    keys = np.unique(mix(np.arange(50_000, dtype=np.uint64), 3))
    s = Sealed(keys)
    assert s.has(keys).all() and len(s.prints) + len(s.exact) == len(keys)
    other = mix(np.arange(60_000, 160_000, dtype=np.uint64), 3)
    assert s.has(other[~np.isin(other, keys)]).mean() < 1e-4
    few = Sealed(keys, bits=6)
    assert 0.005 < few.has(other).mean() < 0.03
    assert not Sealed(np.zeros(0, np.uint64)).has(keys).any()
    for x in (s, few, Sealed(keys, bits=12), Sealed(np.zeros(0, np.uint64))):
        assert (Sealed.from_bytes(x.to_bytes()).has(other) == x.has(other)).all()


@pytest.mark.parametrize("batch_rows", [50, 400, 1 << 20])
def test_seen_before(spark, batch_rows):
    r = random.Random(batch_rows)
    keys = [r.getrandbits(62) for _ in range(300)] + [-5]
    data = [(i, r.choice(keys) if r.random() < 0.6 else (None if r.random() < 0.1 else keys[0])) for i in range(0, 4000, 2)]
    data += [(4001, keys[1]), (4001, keys[1]), (None, keys[2]), (4003, -7), (4003, -7)]
    r.shuffle(data)
    old = [(k,) for k in keys[:40]] * 2 + [(None,)]
    df = frame(spark, data, "row_id bigint, kmer_key bigint").withColumn("k", F.lit("clash")).withColumn("route", F.lit(0)).repartition(5)
    out = seen_before(df, "kmer_key", "row_id", frame(spark, old, "kmer_key bigint"), batch_rows=batch_rows)
    first = {}
    for i, k in data:
        if i is not None and k is not None:
            first[k] = min(i, first.get(k, i))
    want = {i for i, k in data if i is not None and k is not None and (i > first[k] or k in keys[:40])}
    assert {x.row_id for x in out.collect()} == want


def test_seen_before_with_weak_fingerprints_measures_its_errors(spark):
    df = spark.range(60_000).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("k"))
    out = seen_before(df, "k", "row_id", batch_rows=2000, bits=4)
    wrong = out.count()
    got = answer_errors(df, "k", "row_id", out).first()
    assert wrong > 600 and (got.n_answers, got.n_wrong) == (60_000, wrong)
    assert seen_before(df.limit(0), "k", "row_id").count() == 0


def test_seen_keys_are_kept_sealed(spark, tmp_path):
    path = str(tmp_path / "seen")
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("k"))
    keys(0, 3000).write.parquet(str(tmp_path / "first"))
    first = spark.read.parquet(str(tmp_path / "first"))
    for df in (first.limit(0), first.limit(0), first):
        assert SeenKeys(spark, path, rows_each=200).add(df, "k", "row_id").count() == 0
    shutil.rmtree(tmp_path / "first")  # no earlier keys to read any more
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "seen").rglob("*.parquet")}
    before = files()
    # another session and batch, with more partitions; ids start anew, so the order of batches is what counts
    again = keys(1000, 9000).withColumn("row_id", F.col("row_id") - 1000)
    got = {x.row_id for x in SeenKeys(spark.newSession(), path, rows_each=100).add(again, "k", "row_id").collect()}
    assert got == set(range(2000))
    assert {f: t for f, t in files().items() if f in before} == before
    assert len({f.split("parts=")[1].split("/")[0] for f in files()}) == 2
    third = keys(0, 20_000).withColumn("k", F.when(F.col("row_id") % 7 == 0, F.lit(None)).otherwise(F.col("k")))
    got = {x.row_id for x in SeenKeys(spark, path, rows_each=100).add(third, "k", "row_id").collect()}
    assert got == {i for i in range(9000) if i % 7}
    assert SeenKeys(spark, path).add(third.limit(0), "k", "row_id").count() == 0
    held = sum(len(Sealed.from_bytes(x.sealed).prints) for x in spark.read.parquet(path).filter("kind = 'sealed'").collect())
    assert held <= 9000 + 11_000


@pytest.mark.parametrize("files", [1, 5])
def test_error_rate_counts_every_row(spark, tmp_path, monkeypatch, files):
    r = random.Random(8)
    keys = [r.getrandbits(62) for _ in range(3000)]
    data = [(i, keys[0] if i % 4 == 0 else None if i % 50 == 1 else r.choice(keys)) for i in range(8000)]
    data += [(8001, -3), (8001, -3), (8002, -4), (8002, keys[0]), (None, keys[1])]
    r.shuffle(data)
    frame(spark, data, "row_id bigint, kmer_key bigint").repartition(files).write.parquet(str(tmp_path / "kmers.parquet"))
    frame(spark, [(k,) for k in keys[:200]] * 2 + [(None,)], "kmer_key bigint").write.parquet(str(tmp_path / "seen_keys.parquet"))
    d = str(tmp_path)
    weak = seen_before(key_queries.table(spark, d, "kmers"), "kmer_key", "row_id", key_queries.table(spark, d, "seen_keys"), batch_rows=300, bits=4)
    monkeypatch.setattr(key_queries, "seen_before", lambda *args, **kw: weak)
    looked = [(i, k) for i, k in data if i is not None and k is not None]
    first = {}
    for i, k in looked:
        first[k] = min(i, first.get(k, i))
    true = Counter(i for i, k in looked if i > first[k] or k in keys[:200])
    called = Counter(x.row_id for x in key_queries.p3_found(spark, d).collect())
    wrong = (called - true).total() + (true - called).total()
    got = key_queries.p3_error_rate(spark, d).filter("bits = 32").first()
    assert wrong > 20 and (got.n_answers, got.n_wrong) == (len(looked), wrong) and got.wrong_share == wrong / len(looked)


def test_answer_errors_of_any_answers(spark):
    df = frame(spark, [(0, 1), (1, 1), (2, 2), (3, 3), (4, 9)], "row_id bigint, k bigint")
    found = lambda *ids: frame(spark, [(i,) for i in ids], "row_id bigint")
    assert answer_errors(df, "k", "row_id", found(1, 4), found(9), "row_id").first()[:2] == (5, 0)
    assert answer_errors(df, "k", "row_id", found(1, 2)).first()[:2] == (5, 1)  # a new key called seen
    assert answer_errors(df, "k", "row_id", found()).first()[:2] == (5, 1)  # a seen key called new
    assert tuple(answer_errors(df.limit(0), "k", "row_id", found()).first()) == (0, 0, None)


def test_wavelet_matrix_steps():
    r = np.random.default_rng(1)
    s = r.integers(0, 5, 1000).astype(np.uint8)
    w = WaveletMatrix(s)
    for c in range(5):
        i = r.integers(0, 1001, 50)
        assert (w.step(i, np.full(50, c)) == (s < c).sum() + np.array([(s[:k] == c).sum() for k in i])).all()


def spans_by_hand(data, span):
    texts = sorted({(i, s.upper()) for i, s in data if i is not None and s})
    seen = {}
    for i, s in texts:
        for k in range(len(s) - span + 1):
            w = s[k : k + span]
            if set(w) <= set("ACGT"):
                seen.setdefault(w, set()).add(i)
    out = set()
    for i, s in texts:
        on = [False] * (len(s) + 1)
        for k in range(len(s) - span + 1):
            if len(seen.get(s[k : k + span], ())) > 1:
                on[k : k + span] = [True] * span
        at = None
        for k, x in enumerate(on):
            if x and at is None:
                at = k
            if not x and at is not None:
                out.add((i, at, k))
                at = None
    return sorted(out)


@pytest.mark.parametrize("seed,part", [(1, 10**9), (2, 2000), (3, 300), (4, 60)])
def test_shared_spans(spark, seed, part):
    r = random.Random(seed)
    base = "".join(r.choice("ACGT") for _ in range(400))
    data = []
    for i in range(60):
        a = r.randint(0, 330)
        s = base[a : a + r.randint(10, 90)] if r.random() < 0.5 else "".join(r.choice("ACGT") for _ in range(r.randint(0, 90)))
        if r.random() < 0.3 and s:
            k = r.randrange(len(s))
            s = s[:k] + r.choice("NnACGT") + s[k + 1 :]
        data.append((i, s.lower() if r.random() < 0.2 else s))
    data += [(100 + i, "A" * r.randint(30, 70)) for i in range(6)] + [(200, data[0][1]), (201, base[:80]), (202, base[:80]), (203, base[:80])]
    data += data[:9] + [(None, base), (300, None), (301, ""), (302, "N" * 90), (303, "N" * 90), (304, base * 3), (304, "AC" * 60)]
    df = frame(spark, data, "read_id bigint, seq string").withColumn("text", F.lit("clash")).withColumn("record", F.lit(0)).repartition(6)
    got = shared_spans(df, "read_id", "seq", 30, 12, part)
    assert [tuple(x) for x in sorted(got.collect())] == spans_by_hand(data, 30)


def test_shared_spans_of_nothing(spark):
    assert shared_spans(frame(spark, [], "read_id bigint, seq string"), "read_id", "seq").count() == 0
    assert shared_spans(frame(spark, [(1, "ACGT"), (2, None)], "read_id bigint, seq string"), "read_id", "seq").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matching_statistics(seed):
    r = np.random.default_rng(seed)
    span = int(r.integers(5, 50))
    base = r.integers(1, 5, 200)
    pieces, low, high = [], [], []
    for i in range(40):
        a = int(r.integers(0, 150))
        p = base[a : a + int(r.integers(1, 60))].copy() if i % 2 else r.integers(1, 3, int(r.integers(1, 40)))
        if i % 6 == 1:
            p[len(p) // 2] = 4
        pieces.append(p)
        low.append(i // 2)
        high.append(i // 2 if i % 7 else i // 2 + 1)
    codes = np.concatenate([np.r_[p, 0] for p in pieces]).astype(np.uint8)
    length = np.array([len(p) for p in pieces])
    ends = np.cumsum(length + 1) - 1
    ix = SpanIndex(codes, np.repeat(low, length + 1), np.repeat(high, length + 1), span)
    order = np.argsort(-length, kind="stable")
    holders = {}
    for p, a, b in zip(pieces, low, high):
        for i in range(len(p)):
            for j in range(i + 1, min(len(p), i + span) + 1):
                holders.setdefault(tuple(p[i:j]), set()).update((a, b))
    for j, has in enumerate(ix.statistics(codes, ends[order], length[order])):
        for p, n in zip((pieces[k] for k in order), has):
            i = len(p) - 1 - j
            want = max([e - i for e in range(i + 1, min(len(p), i + span) + 1) if len(holders[tuple(p[i:e])]) > 1], default=0)
            assert n == want
