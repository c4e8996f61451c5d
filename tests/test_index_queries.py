import random

from pyspark.sql import functions as F

from weftline.functions.dna import reverse_complement
from weftline.operators import graph, mems, ordered, text
from weftline.sources.hit_files import write_gaf


def dna_text(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def reverse_complement_of(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def both_strands(spark, r):
    ahead = [dna_text(r, 50) for _ in range(3)]
    flip = {"A": "T", "C": "G", "G": "C", "T": "A"}
    back = ["".join(flip[c] for c in reversed(s)) for s in ahead]
    return [s for pair in zip(ahead, back) for s in pair]


def test_ranges_are_extended_by_every_letter(spark):
    texts = both_strands(spark, random.Random(1))
    suf = sorted((s[o:], i, o) for i, s in enumerate(texts) for o in range(len(s) + 1))
    t = spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")
    runs = text.bwt_runs(text.suffix_array(t))

    def span(w):
        own = [k for k, x in enumerate(suf) if x[0].startswith(w)]
        return (own[0], own[-1]) if own else None

    words = ["A", "CG", "TTA", "GAC", "C", "T", "AC", "GG"]
    ranges = {span(w): w for w in words if span(w)}
    df = spark.createDataFrame(list(ranges), "range_start bigint, range_end bigint")
    got = rows(text.extend_ranges(df, runs))
    assert got == sorted(((*k, c, *span(c + w)) for k, w in ranges.items() for c in "ACGT" if span(c + w)), key=repr)
    letters = [texts[i][o - 1] if o else "$" for _, i, o in suf]
    pts = spark.createDataFrame([(p,) for p in (0, 1, 7, 50, len(suf))], "p bigint")
    for x in text.symbol_ranks(pts, "p", runs).collect():
        assert [x[f"rank_{c}"] for c in "ACGNT"] == [letters[: x.p].count(c) for c in "ACGNT"]
    first = text.first_symbols(pts, "p", text.symbol_table(text.text_symbols(t), "ch", "n"))
    assert {x.p: x.first_ch for x in first.collect()} == {p: (suf[p][0][:1] or "$") if p < len(suf) else None for p in (0, 1, 7, 50, len(suf))}


def test_both_strands_mirror_each_other(spark):
    texts = both_strands(spark, random.Random(2))
    t = spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")
    sa = text.suffix_array(t)
    words = sorted({s[k : k + 12] for s in texts for k in range(0, 39, 5)})
    p = spark.createDataFrame([(w,) for w in words], "pattern string").withColumn("rc", reverse_complement(F.col("pattern")))
    ahead = text.occurrences(p.select("pattern"), t, 8)
    back = text.occurrences(p.select(F.col("rc").alias("pattern")), t, 8).select(reverse_complement(F.col("pattern")).alias("pattern"), "seq_id", "seq_off")
    own = {x.pattern: x for x in text.bi_intervals(ahead, back, sa).collect()}
    flipped = {x.pattern: x for x in text.bi_intervals(back, ahead, sa).collect()}
    assert set(own) == set(words)
    for w, x in own.items():
        y = flipped[w]
        assert (x.forward_start, x.reverse_start, x.size) == (y.reverse_start, y.forward_start, y.size)


def test_short_words_are_extended_without_sorting(spark, monkeypatch, tmp_path):
    from weftline.plans import sequences

    r = random.Random(6)
    texts = [dna_text(r, 60), "GATTACAN", "", "A", "NNACG", dna_text(r, 60), "GATTACAN"]
    spark.createDataFrame([(9 - i, s) for i, s in enumerate(texts)], "seq_id bigint, seq string").write.parquet(str(tmp_path / "sequences.parquet"))
    every = [s for t in texts for s in (t, t[::-1].translate(str.maketrans("ACGT", "TGCA")))]
    suf = sorted(s[o:] for s in every for o in range(len(s) + 1))
    back = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    first = lambda w: next(k for k, x in enumerate(suf) if x.startswith(w))
    many = lambda w: sum(x.startswith(w) for x in suf)
    words = {x[:3] for x in suf if len(x) > 2}
    want = [(first(o), first(back(o)), many(o), c, first(w), first(back(w)), many(w), side) for w in words for o, c, side in ((w[1:], w[0], "before"), (w[:2], w[2], "behind"))]
    monkeypatch.setattr(text, "suffix_array", None)
    assert rows(sequences.bi_extended(spark, str(tmp_path))) == sorted(want, key=repr)


def test_longest_runs_need_no_other_tags(spark, monkeypatch, tmp_path):
    from weftline.operators import tags
    from weftline.plans import sequences

    r = random.Random(8)
    base = dna_text(r, 160)
    texts = [base, base[:96] + dna_text(r, 40), base[7:], "", base, dna_text(r, 64) + base[64:128]]
    spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string").write.parquet(str(tmp_path / "sequences.parquet"))
    spark.createDataFrame([(1, base[20:90]), (2, base[60:130] + "T"), (3, texts[5][10:50])], "read_id bigint, seq string").write.parquet(str(tmp_path / "reads.parquet"))
    ix = sequences.Index(spark, str(tmp_path))
    places = sequences._places(ix, spark, str(tmp_path))
    want = rows(mems.longest_run_hits(places, ix.sa, tags.tag_runs(tags.tag_array(ix.sa.drop("ch"), ix.positions))))
    every = rows(tags.tag_runs(tags.tag_array(ix.sa.drop("ch"), ix.positions)))
    some = rows(tags.sharing_runs(tags.sharing_rows(places, ix.sa, ix.positions)))
    assert some == [x for x in every if x[1:4] in {y[1:4] for y in some}] and 0 < len(some) < len(every)
    monkeypatch.setattr(tags, "tag_array", None)
    assert want and rows(sequences.longest_run_hits(spark, str(tmp_path))) == want


def test_component_arrays_are_merged_by_buckets(spark, monkeypatch, tmp_path):
    from weftline.operators import suffix_sort, tags
    from weftline.plans import sequences

    r = random.Random(9)
    a, b, c = dna_text(r, 320), dna_text(r, 192), dna_text(r, 96)
    texts = [c, "", a, a[:64] + b[64:128] + dna_text(r, 7), reverse_complement_of(b), "A" * 300, "A" * 70 + "C", "N" * 40, "", c[:64], dna_text(r, 20), a]
    spark.createDataFrame([(3 * i - 4, s) for i, s in enumerate(texts)], "seq_id bigint, seq string").write.parquet(str(tmp_path / "sequences.parquet"))
    ix = sequences.Index(spark, str(tmp_path))
    nodes, steps = ix.graph
    old = dict(rows(graph.path_components(steps, graph.components(nodes, graph.step_edges(steps)))))
    new = dict(rows(graph.joint_paths(ix.texts, steps)))
    groups = lambda comp: sorted(sorted(k for k in comp if comp[k] == v) for v in set(comp.values()))
    assert new.keys() - old.keys() == {-1, 20} and groups(new) == sorted([*groups(old), [-1], [20]]) and [2, 5, 8, 29] in groups(new)
    assert all(v == min(k for k in new if new[k] == v) for v in new.values())
    want = rows(tags.tag_runs(tags.tag_array(text.suffix_array(ix.texts).drop("ch"), ix.positions)))
    monkeypatch.setattr(suffix_sort, "_SORTED", 90)
    monkeypatch.setattr(suffix_sort, "_PASS", 400)
    monkeypatch.setattr(sequences.text, "suffix_array", None)
    monkeypatch.setattr(tags, "tag_array", None)
    assert len(want) > 900 and rows(sequences.tag_merge(spark, str(tmp_path))) == want


def test_nothing_is_merged(spark, tmp_path):
    from weftline.plans import sequences

    for name, own in (("none", []), ("empty", [(4, ""), (7, "")])):
        spark.createDataFrame(own, "seq_id bigint, seq string").write.parquet(str(tmp_path / name / "sequences.parquet"))
        assert rows(sequences.tag_merge(spark, str(tmp_path / name))) == [(0, 0, 0, 0, 2)][: len(own)]


def test_suffix_matches_and_gaf(spark, tmp_path):
    r = random.Random(3)
    base = dna_text(r, 80)
    t = spark.createDataFrame([(0, base), (1, dna_text(r, 60))], "seq_id bigint, seq string")
    q = spark.createDataFrame([(1, dna_text(r, 20) + base[30:60]), (2, base[5:50] + "TTTTTTTT"), (3, "ACG")], "read_id bigint, seq string")
    got = dict(rows(mems.suffix_matches(q, t, 12)))
    assert got[1] >= 30 and 3 not in got and 2 not in got
    nodes, steps = graph.chop(t, 16)
    _, places = mems.find_mems(q, t, 20)
    write_gaf(mems.hit_paths(places, graph.path_positions(steps, nodes)), q, str(tmp_path / "gaf"))
    lines = [x.value.split("\t") for x in spark.read.text(str(tmp_path / "gaf")).collect()]
    assert {x[0] for x in lines} == {"1", "2"} and all(len(x) == 12 and int(x[3]) - int(x[2]) == int(x[9]) and int(x[8]) <= int(x[6]) for x in lines)


def test_end_rows_need_no_index(spark, monkeypatch):
    texts = ["GATTACA", "", "TTT", "GATTACA", "ACNGT"]
    t = spark.createDataFrame([(5 - 2 * i, s) for i, s in enumerate(texts)], "seq_id bigint, seq string")
    sa = text.suffix_array(t).join(t, "seq_id").filter(F.col("seq_off") == F.length("seq"))
    want = rows(sa.select("bwt_pos", "seq_id", "seq_off"))
    monkeypatch.setattr(text, "suffix_array", None)
    assert rows(text.end_rows(t)) == want


def test_suffixes_are_sorted_in_buckets_and_passes(spark, monkeypatch):
    from weftline.operators import suffix_sort

    r = random.Random(4)
    base = dna_text(r, 700)
    texts = [base, base[100:], base[:400] + "N" * 60 + base[:400], "A" * 500, "A" * 300 + "C", "AC" * 150, "", "N", base]
    t = spark.createDataFrame([(7 - i, s, i % 3 - 1) for i, s in enumerate(texts)], "seq_id bigint, seq string, part bigint")
    monkeypatch.setattr(suffix_sort, "_SORTED", 300)
    monkeypatch.setattr(suffix_sort, "_PASS", 1500)
    monkeypatch.setattr(suffix_sort, "_BLOCK", 64)

    def naive(own):
        return [(i, o) for _, i, o in sorted((s[o:], 7 - i, o) for i, s in own for o in range(len(s) + 1))]

    want = naive(enumerate(texts))
    sa = text.suffix_array(t.drop("part"))
    got = sa.orderBy("bwt_pos").collect()
    assert [(x.seq_id, x.seq_off) for x in got] == want and [x.bwt_pos for x in got] == list(range(len(want)))
    assert [x.ch for x in got] == [texts[7 - i][o - 1] if o else "$" for i, o in want]
    alone = text.suffix_array(t, "part")
    for part in (-1, 0, 1):
        own = alone.filter(F.col("part") == part).orderBy("bwt_pos").collect()
        assert [(x.bwt_pos, x.seq_id, x.seq_off) for x in own] == [(k, *x) for k, x in enumerate(naive((i, s) for i, s in enumerate(texts) if i % 3 - 1 == part))]
    far = {x.bwt_pos: (x.next_seq, x.next_off) for x in text.next_text_position(sa, 7).collect()}
    assert far == {k: want[k + 7] if k + 7 < len(want) else (None, None) for k in range(len(want))}
    assert rows(text.next_text_position(sa.repartition(5), 7)) == rows(text.next_text_position(sa, 7))
    runs, k = [], 0
    while k < len(got):
        n = 1
        while got[k].ch != "$" and k + n < len(got) and got[k + n].ch == got[k].ch:
            n += 1
        runs.append((k, got[k].ch, n))
        k += n
    assert rows(text.bwt_runs(sa)) == rows(text.bwt_runs(sa.repartition(5))) == sorted(runs, key=repr)
    assert rows(text.text_runs(t.drop("part"))) == sorted(runs, key=repr)
    assert text.text_runs(t.filter("part > 9").drop("part")).count() == 0


def test_rank_blocks_need_no_suffix_array(spark, monkeypatch, tmp_path):
    from weftline.plans import sequences

    r = random.Random(7)
    texts = [dna_text(r, 90), "GATTACAN" * 9, "", "A" * 40]
    spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string").write.parquet(str(tmp_path / "sequences.parquet"))
    want = rows(text.rank_blocks(text.bwt_runs(text.suffix_array(spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")))))
    monkeypatch.setattr(text, "suffix_array", None)
    assert rows(sequences.rank_blocks(spark, str(tmp_path))) == want


def test_order_is_met_as_it_is_read(spark):
    df = spark.range(1000, 41000).repartition(3).sortWithinPartitions("id")
    values = df.select("id", F.expr("if(id % 2000 < 500, null, id div 700)").alias("v"), F.col("id").alias("w"))
    want, last = [], None
    for i in range(1000, 41000):
        v = None if i % 2000 < 500 else i // 700
        if want and v == last:
            want[-1] = (*want[-1][:2], want[-1][2] + 1)
        else:
            want.append((i, v, 1))
        last = v
    for shape in (values, values.coalesce(1).sortWithinPartitions("id"), values.repartition(7)):
        assert rows(ordered.run_lengths(shape, [], "id", ["v"])) == sorted(want, key=repr)
        assert rows(ordered.with_row_behind(shape, "id", {"x": "w"}, 9).select("id", "w", "x")) == rows(values.select("id", "w", F.expr("if(id + 9 < 41000, id + 9, null)").alias("x")))


def test_patterns_are_found_by_numbers(spark):
    r = random.Random(5)
    base = dna_text(r, 120)
    texts = [base, base[30:] + "acgR" + base[:40], "A" * 40, "", base[5:]]
    words = [base[:9], base[3:40], "A" * 9, "A" * 12, "acgR" + base[:9], base[20:32] + "T", base[7:14], "é" * 12]
    t = spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")
    want = [(w, i, o) for w in words if len(w) >= 9 for i, s in enumerate(texts) for o in range(len(s)) if s.startswith(w, o)]
    found = text.occurrences(spark.createDataFrame([(w,) for w in words], "pattern string"), t, 9)
    assert rows(found) == sorted(want, key=repr)
    few = [w for w in words if len(w) in (9, 12)]
    assert rows(text.occurrences(spark.createDataFrame([(w,) for w in few], "pattern string"), t, 9)) == sorted((x for x in want if x[0] in few), key=repr)
    seeds = spark.createDataFrame([(w[:9],) for w in words if len(w) >= 9], "pattern string").select("pattern", text.as_bytes(F.col("pattern")).alias("_b"))
    own = {x.pattern: x.h for x in seeds.mapInArrow(text._hashes([9], False), "pattern string, h bigint").collect()}
    every = spark.createDataFrame([(0, base)], "seq_id bigint, seq string").select("seq_id", text.as_bytes(F.col("seq")).alias("_b")).mapInArrow(text._hashes([9], True), "seq_id bigint, seq_off bigint, h bigint").collect()
    assert len(every) == 112 and own[base[3:12]] == every[3].h and own[base[:9]] != every[3].h
