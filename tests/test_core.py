import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import dna
from weftline.operators import graph, mems, ordered, skew, tags, text
from weftline.sources.gfa import read_gfa
from weftline.sources.hit_files import write_hits
from weftline.sources.index_store import open_index, save_index
from weftline.sources.lines import read_lines
from weftline.streaming.reads import stream_mems

TEXTS = ["GATTACAT", "AGATACAT", "GATACAT", "GATTAGAT", "GATTAGATA"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def dna_text(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


def naive_sa(texts):
    suf = sorted((s[o:], i, o) for i, s in enumerate(texts) for o in range(len(s) + 1))
    return [(i, o) for _, i, o in suf]


def naive_mems(read, texts, length, need):
    def occ(w):
        return sum(t.startswith(w, i) for t in texts for i in range(len(t)))

    ends = []
    for x in range(len(read)):
        e = x
        while e < len(read) and occ(read[x : e + 1]) >= max(1, need):
            e += 1
        ends.append(e)
    return [(x, e, occ(read[x:e])) for x, e in enumerate(ends) if e - x >= length and (x == 0 or e > ends[x - 1])]


@pytest.mark.parametrize("texts", [TEXTS, ["AAAA", "AAAA", "AA"], ["ACGT" * 30, "ACGT" * 30 + "A", "N", ""], ["A" * 150, "A" * 149 + "C", "A" * 150]])
def test_suffix_array_and_what_hangs_on_it(spark, texts):
    t = frame(spark, list(enumerate(texts)), "seq_id bigint, seq string")
    sa = text.suffix_array(t).orderBy("bwt_pos").collect()
    want = naive_sa(texts)
    assert [(r.seq_id, r.seq_off) for r in sa] == want and [r.bwt_pos for r in sa] == list(range(len(want)))
    b = text.suffix_array(t)
    letters = [r.ch for r in b.orderBy("bwt_pos").collect()]
    assert letters == [texts[i][o - 1] if o else "$" for i, o in want]
    place = {p: k for k, p in enumerate(want)}
    lf = {r.bwt_pos: r.lf_pos for r in text.lf_mapping(b).collect()}
    for k, (i, o) in enumerate(want):
        assert lf[k] == (place[i, o - 1] if o else place[i, len(texts[i])])
    runs = text.bwt_runs(b).orderBy("bwt_start").collect()
    assert "".join(r.ch * r.length for r in runs) == "".join(letters)
    assert all(a.ch != c.ch or a.ch == "$" for a, c in zip(runs, runs[1:]))
    counts = rows(text.symbol_table(text.text_symbols(t), "ch", "n").select("ch", "freq"))
    assert counts == sorted((c, letters.count(c)) for c in set(letters))


def test_suffix_array_of_long_repeats(spark):
    r = random.Random(5)
    long = dna_text(r, 700)
    texts = [long, long[:650] + "T", long, long[200:], "CA" * 300, "CA" * 299 + "N", long[:699]]
    sa = text.suffix_array(frame(spark, list(enumerate(texts)), "seq_id bigint, seq string")).orderBy("bwt_pos").collect()
    want = naive_sa(texts)
    assert [(x.seq_id, x.seq_off) for x in sa] == want and [x.bwt_pos for x in sa] == list(range(len(want)))


def test_suffix_array_of_nothing(spark):
    assert text.suffix_array(frame(spark, [], "seq_id bigint, seq string")).count() == 0


def test_normal_texts(spark):
    t = frame(spark, [(1, "acg", "x"), (1, "acg", "y"), (None, "A", "x"), (2, None, "x"), (3, "", "x")], "seq_id bigint, seq string, length string")
    assert rows(text.normal(t)) == [(1, "ACG"), (3, "")]


def test_windows(spark):
    t = frame(spark, [(1, "ACGNACGT"), (2, "AC"), (3, ""), (4, "aéACG")], "seq_id bigint, seq string")
    assert rows(text.windows(t, "seq_id", "seq", 3)) == [(1, 0, "ACG"), (1, 4, "ACG"), (1, 5, "CGT"), (4, 2, "ACG")]
    with pytest.raises(ValueError):
        text.windows(t, "seq_id", "seq", 0)


def test_keys_and_words(spark):
    r = random.Random(1)
    k = [dna_text(r, 31) for _ in range(20)]
    df = frame(spark, [(s,) for s in k] + [("ACGTN",), (None,)], "s string").withColumn("key", dna.kmer_key(F.col("s")))
    for row in df.withColumn("back", dna.kmer_text(F.col("key"), 31)).collect():
        assert row.key is None if row.s is None or "N" in row.s else row.back == row.s
    runs = frame(spark, [(7, 1, 1023, 511), (0, 0, 0, 1), (2**30, 1, 5, 600), (5, 0, 1024, 3), (2**44 + 5, 0, 1, 1), (2**44 - 1, 1, 2, 3)], "n bigint, r int, o int, l bigint")
    word = dna.encode_run(F.col("n"), F.col("r"), F.col("o"), F.col("l"))
    got = runs.select("n", "r", "o", "l", dna.decode_run(word).alias("d"), word.isNull().alias("bad")).collect()
    assert [x.bad for x in got] == [False, False, True, True, True, False]
    assert all((x.d.node_id, x.d.is_reverse, x.d.node_offset, x.d.length) == (x.n, x.r, x.o, x.l) for x in got if not x.bad)
    labels = frame(spark, [(999,), (1234,), (1999,), (5_670_000,), (2_000_000_000,)], "n bigint").select(dna.format_number(F.col("n"))).collect()
    assert [x[0] for x in labels] == ["999", "1.2K", "1.9K", "5.6M", "2.0B"]
    assert frame(spark, [("AaNnCgT",)], "s string").select(dna.reverse_complement(F.col("s"))).first()[0] == "AcGnNtT"


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_along_an_order(spark, width):
    r = random.Random(width)
    data = [(g, o, r.choice([None, 1, 2])) for g in (1, 2) for o in sorted(r.sample(range(60), 25))]
    df = frame(spark, data, "g int, o bigint, v bigint")
    got = {(x.g, x.o): (x.p, x.n, x.s) for x in ordered.with_sum_before(ordered.with_neighbour(ordered.with_neighbour(df, ["g"], "o", {"p": "v"}, width), ["g"], "o", {"n": "v"}, width, ahead=True), ["g"], "o", "v", "s", width).collect()}
    for g in (1, 2):
        own = [d for d in data if d[0] == g]
        for k, (_, o, _v) in enumerate(own):
            assert got[g, o] == (own[k - 1][2] if k else None, own[k + 1][2] if k + 1 < len(own) else None, sum(d[2] or 0 for d in own[:k]))


@pytest.mark.parametrize("width", [2, 7, 1 << 20])
def test_run_lengths(spark, width):
    r = random.Random(5)
    data, at = [], 0
    for _ in range(60):
        at += r.choice([0, 0, 0, 3])
        n = r.randint(1, 4)
        data.append((at, n, r.choice([1, 2, None])))
        at += n
    want = []
    for s, n, v in data:
        if want and want[-1][0] + want[-1][1] == s and want[-1][2] == v:
            want[-1] = (want[-1][0], want[-1][1] + n, v)
        else:
            want.append((s, n, v))
    r.shuffle(data)
    got = ordered.run_lengths(frame(spark, data, "s bigint, n bigint, v bigint"), [], "s", ["v"], "n", width=width)
    assert sorted((x.s, x.length, x.v) for x in got.collect()) == want
    one = frame(spark, [(i, 1) for i in r.sample(range(500), 500)], "s bigint, v bigint")
    assert rows(ordered.run_lengths(one, [], "s", ["v"], width=width)) == [(0, 1, 500)]
    assert ordered.run_lengths(frame(spark, [], "s bigint, v bigint"), [], "s", ["v"]).count() == 0


def test_split_runs(spark):
    lengths = [510, 511, 512, 1022, 1023, 70000]
    got = ordered.split_runs(frame(spark, [(i * 10**6, n) for i, n in enumerate(lengths)], "s bigint, length bigint"), "s", "length", 511).collect()
    for i, n in enumerate(lengths):
        own = sorted((x.s, x.length) for x in got if x.s // 10**6 == i)
        assert sum(x[1] for x in own) == n and all(x[1] == 511 for x in own[:-1]) and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))


def test_intervals(spark):
    r = random.Random(9)
    runs = [(i * 10, r.randint(1, 10), i) for i in range(40)]
    ranges = [(a, a + r.randint(0, 90)) for a in r.sample(range(380), 30)] + [(0, 0), (399, 399)]
    run = frame(spark, [(s, n, v, 0, 0) for s, n, v in runs], "bwt_start bigint, length bigint, node_id bigint, is_reverse int, node_offset int")
    got = {(x.range_start, x.range_end, x.node_id): x.overlap for x in tags.query_runs(frame(spark, ranges, "range_start bigint, range_end bigint"), run).collect()}
    want = {(a, b, v): min(b, s + n - 1) - max(a, s) + 1 for a, b in ranges for s, n, v in runs if s <= b and a < s + n}
    assert got == want
    pts = frame(spark, [(p,) for p in range(0, 420, 3)], "p bigint")
    at = {x.p: x.node_id for x in tags.tag_at(pts, "p", run).collect()}
    assert at == {p: next((v for s, n, v in runs if s <= p < s + n), None) for p in range(0, 420, 3)}


def test_tag_table(spark):
    data = [(1, 0, 2048), (1, 5, 2048), (1, 5, 2048), (1, 9, 0), (1, 12, None), (1, 20, 4096), (1, 30, 0), (None, 3, 2048), (2, 0, 0)]
    table = frame(spark, data, "file_id bigint, start_position bigint, graph_position bigint").withColumn("length", F.lit("x"))
    runs = tags.read_runs(table)
    assert rows(runs) == [(1, 0, 2048, 5), (1, 12, 0, 8), (1, 20, 4096, 10), (1, 5, 2048, 4), (1, 9, 0, 3)]
    assert rows(tags.coalesce_runs(runs)) == [(1, 0, 2048, 9), (1, 20, 4096, 10)]
    assert rows(tags.coverage(runs)) == [(1, 3, 19, 30, 19 / 30)]
    lay = tags.whole_layout(runs, 4)
    assert rows(lay.select("bwt_start", "node_id", "length")) == [(0, 0, 4), (24, 2, 10), (4, 1, 5), (9, 1, 4)]
    assert rows(tags.decode_runs(tags.encode_runs(lay)).select("bwt_start", "length")) == [(0, 4), (24, 10), (4, 5), (9, 4)]


def test_runs_are_inserted_into_gaps(spark):
    run = "file_id bigint, start_position bigint, graph_position bigint, length bigint"
    old = frame(spark, [(1, 10, 7, 5), (1, 20, 8, 10), (2, 0, 9, 3)], run)
    new = [(1, 0, 7, 10), (1, 15, 7, 5), (1, 14, 7, 2), (1, 29, 8, 1), (1, 30, 8, 4), (1, 30, 8, 4), (1, 33, 1, 9), (1, 100_000, 2, 5), (2, 10, 7, 5), (2, 4, 1, 100), (2, 200, 3, 0), (None, 5, 5, 5)]
    got = rows(tags.insert_runs(old, frame(spark, new, run)).select("file_id", "start_position", "length", "accepted"))
    want = [(1, 0, 10, True), (1, 14, 2, False), (1, 15, 5, False), (1, 29, 1, False), (1, 30, 4, False), (1, 30, 4, True), (1, 33, 9, False), (1, 100_000, 5, True), (2, 4, 100, True), (2, 10, 5, False), (2, 200, 0, False)]
    assert got == sorted(want, key=repr)
    assert tags.insert_runs(old, old.limit(0)).count() == 0
    assert all(x.accepted for x in tags.insert_runs(old.limit(0), old).collect())


@pytest.mark.parametrize("letters,need", [("ACGT", 1), ("AC", 2), ("AC", 3)])
def test_mems(spark, letters, need):
    r = random.Random(need)
    base = dna_text(r, 60, letters)
    texts = [base, base[:30] + dna_text(r, 20, letters), dna_text(r, 40, letters), ""]
    reads = [base[10:40], dna_text(r, 25, letters) + base[50:], base, "ACGU", "", dna_text(r, 3, letters)]
    t = frame(spark, list(enumerate(texts)), "seq_id bigint, seq string")
    q = frame(spark, list(enumerate(reads)), "read_id bigint, seq string")
    got, places = mems.find_mems(q, t, 4, need)
    want = [(i, *m) for i, s in enumerate(reads) for m in naive_mems(s, [x for x in texts if x], 4, need)]
    assert rows(got.select("read_id", "mem_start", "mem_end", "size")) == sorted(want, key=repr)
    assert sum(m[3] for m in want) == places.count()
    at = [(x.read_id, x.mem_start, x.mem_end, x.seq_id, x.seq_off) for x in places.collect()]
    assert len(set(at)) == len(at) and all(reads[r][a:b] == texts[s][o : o + b - a] for r, a, b, s, o in at)
    with pytest.raises(ValueError):
        mems.find_mems(q, t, 0)


def test_mems_of_one_letter_on_both_sides(spark):
    t = frame(spark, [(0, "A" * 10_000), (1, "C" + "A" * 9_000)], "seq_id bigint, seq string")
    q = frame(spark, [(1, "A" * 10_000), (2, "A" * 500 + "C" + "A" * 300)], "read_id bigint, seq string")
    got, _ = mems.find_mems(q, t, 31)
    assert rows(got) == [(1, 0, 10_000, 1), (2, 0, 500, 10_000 - 499 + 9_000 - 499), (2, 500, 801, 1)]


def test_tags_of_empty_texts_are_split_and_merged(spark):
    t = frame(spark, [(0, "ACGTACCA"), (1, ""), (2, "GGATTC"), (3, "")], "seq_id bigint, seq string")
    sa = frame(spark, [(k, *p) for k, p in enumerate(naive_sa(["ACGTACCA", "", "GGATTC", ""]))], "bwt_pos bigint, seq_id bigint, seq_off bigint")
    nodes, steps = graph.chop(t, 4)
    tag = tags.tag_array(sa, graph.path_positions(steps, nodes))
    comp = frame(spark, [(0, 0), (2, 2 << 20)], "seq_id bigint, comp_id bigint")
    parts = tags.split_by_component(tag, sa, comp)
    assert parts.select("comp_id").distinct().count() == 4
    assert rows(tags.merge_components(parts, sa, comp)) == rows(tag)


def test_nodes_of_texts_with_many_steps(spark):
    far = (1 << 20) + 3
    texts = [(0, "AAAA" * far + "ACGG"), (1, "AAAA" * 3 + "CCCA"), (2, "")]
    nodes, steps = graph.chop(frame(spark, texts, "seq_id bigint, seq string"), 4)
    assert rows(nodes) == [(0, "AAAA"), (far, "ACGG"), (far + 1 + 3, "CCCA")]
    last = graph.path_positions(steps, nodes).filter(f"step = {far} OR seq_id = 1 AND step = 3")
    assert rows(last.select("seq_id", "step", "path_start", "node_id")) == [(0, far, 4 * far, far), (1, 3, 12, far + 4)]


def test_graph_tags_and_hits(spark):
    r = random.Random(3)
    a = dna_text(r, 100)
    texts = [a, a[:64] + dna_text(r, 33), dna_text(r, 70), a]
    t = frame(spark, list(enumerate(texts)), "seq_id bigint, seq string")
    nodes, steps = graph.chop(t, 16)
    pos = graph.path_positions(steps, nodes)
    label = {x.node_id: x.seq for x in nodes.collect()}
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    walk = {}
    for x in pos.orderBy("seq_id", "step").collect():
        s = label[x.node_id]
        s = "".join(comp[c] for c in reversed(s)) if x.is_reverse else s
        assert len(walk.get(x.seq_id, "")) == x.path_start
        walk[x.seq_id] = walk.get(x.seq_id, "") + s
    assert [walk[i] for i in range(4)] == texts
    sa = text.suffix_array(t)
    tag = tags.tag_array(sa, pos)
    comps = graph.components(nodes, graph.step_edges(steps))
    sc = {x.seq_id: x.comp_id for x in graph.path_components(steps, comps).collect()}
    assert sc[0] == sc[1] == sc[3] != sc[2]
    whole = rows(tags.tag_runs(tag))
    parts = tags.split_by_component(tag, sa, graph.path_components(steps, comps))
    assert rows(tags.tag_runs(tags.merge_components(parts, sa, graph.path_components(steps, comps)))) == whole
    # the same from arrays that were built for each component alone
    alone = text.suffix_array(t.join(graph.path_components(steps, comps), "seq_id"), "comp_id")
    parts = tags.tag_array(alone.withColumnRenamed("bwt_pos", "row_no"), pos)
    assert parts.filter("row_no = 0").count() == 2
    assert rows(tags.tag_runs(tags.merge_components(parts, sa, graph.path_components(steps, comps)))) == whole
    q = frame(spark, [(1, a[10:60])], "read_id bigint, seq string")
    _, places = mems.find_mems(q, t, 20)
    assert mems.hits(places, sa, pos, "sequence").count() == 3
    assert mems.hits(places, sa, pos, "position").count() == 1
    paths = {x.seq_id: x.path for x in mems.hit_paths(places, pos).collect()}
    assert paths[0] == paths[3] == paths[1] and paths[0].count(">") + paths[0].count("<") == 4
    with pytest.raises(ValueError):
        mems.hits(places, sa, pos, "other")


def test_components_of_chains(spark):
    n = 300
    e = [(i, "+", i + 1, "+") for i in range(n)] + [(1000, "+", 1001, "-"), (1001, "+", 1000, "-"), (None, "+", 4, "+"), (7, "+", 7, "+")]
    got = dict(rows(graph.components(frame(spark, [(2000,), (1000,)], "node_id bigint"), frame(spark, e, "from_id bigint, from_orient string, to_id bigint, to_orient string"))))
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 2000: 2000}


def test_key_totals_and_heavy_keys(spark):
    data = [(1, 5)] * 40 + [(2, 5), (2, 5), (None, 5), (3, None), (4, 7)]
    df = frame(spark, data, "v bigint, e bigint").withColumn("field_name", F.lit("clash")).withColumn("n", F.lit(1))
    assert rows(skew.key_totals(df, ["v"], "e")) == [("v", 1, 40, 1), ("v", 2, 2, 1), ("v", 3, 1, 0), ("v", 4, 1, 1)]
    assert rows(skew.heavy_keys(df, ["v"], 0.04)) == [("v", 1, 40, 44), ("v", 2, 2, 44)]
    assert rows(skew.heavy_keys(df, ["v", "e"], 0.5)) == [("e", 5, 43, 44), ("v", 1, 40, 44)]
    assert skew.heavy_keys(df.limit(0), ["v"], 0.03).count() == 0 and skew.key_totals(df.limit(0), ["v"], "e").count() == 0
    small = frame(spark, [(1, "a"), (2, "b"), (2, "c")], "v bigint, w string")
    assert skew.salted_join(df, small, ["v"]).count() == 44
    with pytest.raises(ValueError):
        skew.salted_join(df, small, ["v"], how="full")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ACT\r\n\nAATCG\n")
    (tmp_path / "b.txt").write_text("AAA\n\n\nTCGGG")
    assert rows(read_lines(spark, str(tmp_path) + "/*.txt")) == [(1, "ACT"), (2, "AATCG"), (3, "AAA"), (4, "TCGGG")]
    assert rows(read_lines(spark, str(tmp_path) + "/b.txt", 0)) == [(0, "AAA"), (1, "TCGGG")]
    (tmp_path / "g.gfa").write_text("H\tVN:Z:1.0\nS\t1\tACG\nS\t2\t*\nL\t1\t+\t2\t-\t0M\nP 1#0#x#0 1+,2-\t*\nP\ty\t2+\t*\n")
    g = read_gfa(spark, str(tmp_path / "g.gfa"))
    assert rows(g["nodes"]) == [(1, "ACG"), (2, None)] and rows(g["edges"]) == [(1, "+", 2, "-", "0M")]
    assert rows(g["path_steps"]) == [("1#0#x#0", 0, 1, 0), ("1#0#x#0", 1, 2, 1), ("y", 0, 2, 0)]
    (tmp_path / "w.gfa").write_text("S\tleft\tACG\nS\t7\tG\nS\tright\t*\nL\tleft\t+\t7\t-\t*\nW\tone\t0\tchr1\t5\t9\t>left<7>right\nP\tp\tleft+,right-\t*\n")
    g2 = read_gfa(spark, str(tmp_path / "w.gfa"))
    number = {x.name: x.node_id for x in g2["names"].collect()}
    assert number["7"] == 7 and number["left"] < 0 > number["right"] and len(set(number.values())) == 3
    assert rows(g2["edges"]) == [(number["left"], "+", 7, "-", None)] and rows(g2["paths"]) == [("one#0#chr1#5",), ("p",)]
    assert rows(g2["path_steps"]) == sorted([("one#0#chr1#5", 0, number["left"], 0), ("one#0#chr1#5", 1, 7, 1), ("one#0#chr1#5", 2, number["right"], 0), ("p", 0, number["left"], 0), ("p", 1, number["right"], 1)], key=repr)
    save_index(spark, str(tmp_path / "ix"), {"nodes": g["nodes"]}, {"nodes": "node_id"})
    assert rows(open_index(spark, str(tmp_path / "ix"))["nodes"]) == [(1, "ACG"), (2, None)]
    with pytest.raises(ValueError):
        open_index(spark, str(tmp_path / "none"))
    spark.createDataFrame([("weftline-index", 99, ["nodes"])], "format string, version int, tables array<string>").write.mode("overwrite").parquet(str(tmp_path / "ix/header"))
    with pytest.raises(ValueError, match="version 99"):
        open_index(spark, str(tmp_path / "ix"))
    hits = frame(spark, [(4, 83, 6, 0, 25, 0, 2), (0, 14, 6, 0, 25, 0, 2), (0, 1, 10, 0, 33, 4, 1)], "seq_id bigint, node_id bigint, node_offset int, is_reverse int, mem_length int, mem_start int, read_id bigint")
    write_hits(hits, frame(spark, [(i,) for i in range(6)], "seq_id bigint"), str(tmp_path / "out"))
    read = lambda n: [x[0] for x in spark.read.text(str(tmp_path / "out" / n)).collect()]
    assert sorted(read("hits")) == ["1\t10\t0\t33\t4\t1", "14\t6\t0\t25\t0\t2", "83\t6\t0\t25\t0\t2"]
    assert sorted(map(int, read("starts"))) == [0, 2, 2, 2, 2, 3, 3]


def test_stream(spark, tmp_path):
    t = frame(spark, [(0, "ACGTACGGTTA")], "seq_id bigint, seq string")
    reads = frame(spark, [(1, "acgtac"), (2, ""), (3, None), (4, "GGTTAC")], "read_id bigint, seq string")
    reads.repartition(2).write.parquet(str(tmp_path / "in"))
    q = stream_mems(spark, str(tmp_path / "in"), reads.schema, t, str(tmp_path / "out"), str(tmp_path / "cp"), 4)
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("read_id", "mem_start", "mem_end", "size")) == [(1, 0, 6, 1), (4, 0, 5, 1)]


def test_entry_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "weftline.llm", None)
    monkeypatch.delitem(sys.modules, "weftline.llm.registry", raising=False)
    assert "mems_found" in e.queries() and "p5_found" in e.oracle_sql() and "p1_found" not in e.queries()
