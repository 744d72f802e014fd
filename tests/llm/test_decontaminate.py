from weftline.llm import decontaminate

ITEM = "the train from Berlin leaves at 14:30 and covers 120 km in 2 hours before it reaches Hamburg where Anna waits for it with 3 friends"
OTHER = "the train from Oslo leaves at 09:15 and covers 300 miles in 5 hours before it reaches Bergen where Nils waits for it with 7 friends"
TWICE = "how many apples has Tom if Tom gives 3 apples to Ann and Ann gives 3 apples back to Tom after the lunch with Ann"
MIXED = "how many apples has Bob if Eve gives 3 apples to Joe and Max gives 8 apples back to Liz after the lunch with Sam"
PAD = " ".join(f"filler{i}" for i in range(60))


def test_templates_find_copies_and_other_parameters(spark):
    docs = [(0, None), (1, ""), (2, PAD), (3, f"{PAD} {ITEM} {PAD}"), (4, f"{PAD} x {OTHER} {PAD}"), (5, f"a b c {TWICE}"), (6, f"{PAD} {MIXED}"), (7, " ".join(ITEM.split()[:9])), (7, f"{ITEM}\n{TWICE}")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, ITEM, "x")], "doc_id bigint, text string, item string")
    bench = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, TWICE), (12, "too short"), (13, None)], "item_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_items, r.item_id, r.contaminated) for r in decontaminate.judge(docs, bench).collect())
    assert got == [(-1, 0, None, False), (0, 0, None, False), (1, 0, None, False), (2, 0, None, False), (3, 1, 10, True), (4, 1, 10, True), (5, 1, 11, True), (6, 0, None, False), (7, 2, 10, True), (7, 2, 10, True)]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5


def test_every_offset_is_found_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * i) + " " + ITEM + " z") for i in range(20)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert all(r.contaminated for r in decontaminate.judge(docs, bench).collect())
    assert not any(r.contaminated for r in decontaminate.judge(docs, bench.limit(0)).collect())
    assert decontaminate.judge(docs.limit(0), bench).count() == 0


def test_copies_in_other_case_are_found(spark):
    docs = [(1, f"{PAD} {ITEM.upper()} {PAD}"), (2, f"{PAD} {ITEM.lower()}"), (3, f"{PAD} {TWICE.upper()}"), (4, f"{PAD} {MIXED.upper()}"), (5, PAD.upper())]
    bench = spark.createDataFrame([(10, ITEM), (11, TWICE)], "item_id bigint, text string")
    got = decontaminate.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (2, 10), (3, 11), (4, None), (5, None)]


def test_what_is_found_for_an_item_depends_on_no_other(spark):
    docs = []
    for i in range(8):  # four words changed, each time elsewhere
        words = ITEM.split()
        for k in range(4):
            words[(i + 7 * k) % len(words)] = f"other{k}"
        docs.append((i, f"{'w ' * i}{' '.join(words)} z"))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    alone = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    found = {r.doc_id for r in decontaminate.leaks(docs, alone).collect()}
    for more in ("one two three four five six seven eight", "3", "Anna 5 km", TWICE):
        both = alone.union(spark.createDataFrame([(2, more)], alone.schema))
        assert {r.doc_id for r in decontaminate.leaks(docs, both).where("item_id = 1").collect()} == found


def test_short_items_and_items_of_slots_are_found_by_their_words(spark):
    seven, slots = "which of these seas is the saltiest", "Anna 12 Bob 7 Carl 19 Dora 23 Emil 5 Fred 31"
    docs = [(1, f"{PAD} {seven} {PAD}"), (2, f"{PAD} {seven.upper()}"), (3, f"{PAD} which of these seas is the coldest"), (4, f"{slots} {PAD}"), (5, "Hans 3 Ida 44 Jan 5 Kim 61 Leo 7 Max 8"), (6, None)]
    bench = spark.createDataFrame([(1, seven), (2, slots), (3, " ")], "item_id bigint, text string")
    got = decontaminate.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, None), (4, 2), (5, None), (6, None)]


def test_items_of_one_template_count_each(spark):
    bench = spark.createDataFrame([(i, f"a train leaves at {100 + i} and a boat leaves at {500 + i} so when do they meet at sea") for i in range(30)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{PAD} a train leaves at 7 and a boat leaves at 9 so when do they meet at sea {PAD}"), (2, PAD)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_items, r.item_id) for r in decontaminate.judge(docs, bench).collect())
    assert got == [(1, 30, 0), (2, 0, None)]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word and " * 200_000 + ITEM), (2, "word and " * 200_000)], "doc_id bigint, text string")
    got = decontaminate.judge(docs, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.contaminated) for r in got) == [(1, True), (2, False)]
