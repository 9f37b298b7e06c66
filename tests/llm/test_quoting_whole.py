"""Problem 2: inherited lines without a mark, short or edited ones too, with or without a key of the thread."""

from topicloom.llm import quoting

QUOTED = "> The early probe was sold because the narrow lander had lost its antenna twice.\n> Cold pumps fail at noon.\n> Bring two spare valves."


def test_short_and_edited_lines_repeat_the_own_quotation_without_a_key():
    text = f"{QUOTED}\n\nMy own words come first.\nCold pumps fail at noon.\nThen I say more.\nThe early probe was sold because the broken lander had lost its antenna twice.\nAnd more.\nBring two spare valves.\nThat is all."
    assert quoting.analyse(text).keys == [] and quoting.analyse(text).inherited == {1, 2, 3, 6, 8, 10}


def test_stock_phrases_and_parts_of_new_sentences_stay():
    twice = "> Let me know what you think. The box is old.\n> Let me know what you think. The lamp is new.\n\nLet me know what you think.\n"
    assert quoting.analyse(twice).inherited == {1, 2}
    assert quoting.analyse(f"{QUOTED}\n\nIt seems that the old and\ncold pumps fail at noon.\n").inherited == {1, 2, 3}
    assert quoting.analyse("> It costs 14 crowns more than before.\n\nIt costs 39 crowns more than before.\n").inherited == {1}


def test_short_and_edited_lines_are_known_from_the_thread(spark):
    a = f"In article <77@mail.example>, ann writes:\n{QUOTED}\n\nI agree with all of it.\n"
    b = "In article <77@mail.example>, ann writes:\n> Something else was said.\n\nMy thoughts.\nCold pumps fail at noon.\nMore of mine.\nBring two spare valves.\nThe early probe was sold because the broken lander had lost its antenna twice.\n"
    df = spark.createDataFrame([(1, a), (2, b)], "row_id LONG, data STRING")
    assert {tuple(r) for r in quoting.found(df).collect() if r["row_id"] == 2} == {(2, 1), (2, 2), (2, 5), (2, 7), (2, 8)}


def test_every_span_of_a_thread_is_aligned(spark):
    line = "the cold pump failed at noon and we sold it"
    cut = [" ".join(line.split()[i : i + 6]) for i in range(5)]
    partial = [(i, f"In article <5@mail.example>, ann writes:\n> {x}\n\nMine {i}.\n") for i, x in enumerate(cut)]
    rows = [*partial, (90, f"In article <5@mail.example>, ann writes:\n> {line}\n\nNo.\n"), (91, f"In article <5@mail.example>, ann writes:\n> Other words.\n\nWell.\n{line}\n")]
    found = quoting.found(spark.createDataFrame(rows, "row_id LONG, data STRING"))
    assert {r["line_no"] for r in found.collect() if r["row_id"] == 91} == {1, 2, 5}


def test_lines_of_an_ancestor_in_the_table_are_known_by_its_id_or_by_address_and_day(spark):
    words = "The early probe was sold because the narrow lander had lost its antenna twice."
    other = "Nine steady pumps were moved to the harbour before the long winter began."
    first = f"Message-ID: <1@mail.example>\n\n{words}\n\n--\nAnn Lee\nann@mail.example\n"
    reply = f"In article <1@mail.example>, ann writes:\n> nothing of it\n\nI begin.\n{words}\nI end.\n"
    second = f"{other}\n\n--\nBo Ray\nbo@mail.example\n"
    later = f"On 4 Jul 2019 at 9:04, Bo Ray <bo@mail.example> wrote:\n> no word\n\nI begin.\n{other}\nI end.\n"
    sibling = f"In article <1@mail.example>, ann writes:\n> nothing of it\n\nA third part begins.\n{other}\nIt ends.\n"
    rows = [(1, first, "2019-07-03"), (2, reply, "2019-07-04"), (3, second, "2019-07-04"), (4, later, "2019-07-05"), (5, sibling, "2019-07-05")]
    df = spark.createDataFrame(rows, "row_id LONG, data STRING, _d STRING").selectExpr("row_id", "data", "cast(_d as timestamp) as posted_at")
    lines = {(r["row_id"], r["line_no"]): (r["by_structure"], r["by_comparison"]) for r in quoting.evidence(df).collect()}
    assert lines[2, 5] == (False, True) and (2, 4) not in lines and (2, 6) not in lines
    assert lines[4, 5] == (False, True) and (4, 4) not in lines
    assert (1, 3) not in lines and (3, 1) not in lines and (5, 5) not in lines


def test_comparison_alone_finds_quoted_lines_of_the_thread_when_marks_are_not_read(spark):
    a = f"In article <77@mail.example>, ann writes:\n{QUOTED}\n\nI agree with all of it, and I say so here.\n"
    b = f"In article <77@mail.example>, ann writes:\n{QUOTED}\n\nI see no use in any of it, as I said before.\n"
    df = spark.createDataFrame([(1, a), (2, b)], "row_id LONG, data STRING")
    on, off = quoting.structure(df).cache(), quoting.structure(df, marks=False).cache()
    assert {x for r in off.collect() for x in r["inherited"]} == {1}
    assert sorted(map(tuple, quoting.inherited_in_threads(off, on).collect())) == [(r, n) for r in (1, 2) for n in (2, 3, 4)]


def test_long_introductions_signatures_and_header_blocks():
    who = " ".join(["Annabella"] * 60)
    assert quoting.analyse(f"On 4 Jul 2019, {who} wrote:\n> a\n> b\n\nMine.\n").inherited == {1, 2, 3}
    signature = "\n".join(f"line {i} of a very long signature that nobody would want to read to its end, though it is there" for i in range(30))
    assert quoting.analyse(f"Mine.\n\n-- \n{signature}\n").inherited == set(range(3, 34))
    blank = "\n" * 20
    assert quoting.analyse(f"Mine.\n\n-----Original Message-----{blank}From: Ann{blank}Old words here.\n").inherited == {3, 23, 43}
    prose = "We met the others at noon and they had a lot to say about the box. In the end she wrote:"
    assert quoting.analyse(f"{prose}\nMy poem follows here.\n").inherited == set()
