from cairnlore.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int"


def water_fill(sizes, weights, most):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_ and left > 1e-9:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if target[i] + share[i] > most * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] += share[i]
            break
        for i in over:
            left -= most * sizes[i] - target[i]
            target[i] = most * sizes[i]
        open_ -= over
    return target


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], SCHEMA)


def test_targets_and_takes_match_a_plain_loop(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 3}") for i in range(600)]
    rows += [(600 + i, "a b", None) for i in range(5)] + [(700 + i, "x " * 3, "tiny") for i in range(4)] + [(800, None, "s1"), (801, "", "empty")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water_fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)))
    taken = {s: 0 for s in size}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - want[s]) <= 20.5, (s, taken[s], want[s])  # half of the largest document
    again = {(r.doc_id, r.copies) for r in mixing.mix(frame(spark, rows).repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_take_repeats_rows_and_keeps_their_columns(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "q", None), (3, None, "t"), (4, "d " * 30, "t")]
    docs = frame(spark, rows).withColumnRenamed("size", "copies")
    mixed = mixing.mix(docs)
    got = mixing.take(docs)
    assert got.columns == docs.columns
    want = sum(r.copies for r in mixed.collect())
    assert got.count() == want


def test_copies_of_one_row_are_taken_in_part(spark):
    rows = [(7, "w w", "big")] * 900 + [(i, "w " * 10, "small") for i in range(100, 110)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for source in ("big", "small"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own)
    assert mixing.take(frame(spark, rows)).count() == sum(r.copies for r in got)


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_very_long_text_counts_whole(spark):
    rows = [(1, "word " * 200_000, "a"), (2, "x y", "b"), (3, "x y z", "b")]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert got[1].size == 200_000 and all(r.copies <= 3 for r in got.values())
    assert got[2].target == got[2].source_size * 3  # the small source stops at three times its size
