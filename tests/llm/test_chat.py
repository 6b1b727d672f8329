from tesselle.llm import chat


def render(turns, me):
    text, mask = "", []
    for _, who, said in turns:
        head = f"{chat.START}assistant\n" if who == me else f"{chat.START}system\n" if who == "system" else f"{chat.START}user name={who}\n"
        text += head + said + chat.END
        mask.append(f"0:{len(head)},{int(who == me)}:{len(said + chat.END)}")
    return text, ",".join(mask)


def test_every_perspective_and_parts(spark):
    turns = [(k, ["ann", "bob", "cat", "system"][k % 4], f"line {k}") for k in range(130)]
    df = spark.createDataFrame([(7, *t, 1) for t in turns], "conv_id long, turn long, role string, text string, part int")
    got = {}
    for r in chat.rotate_perspectives(df, part_turns=50, piece_turns=7).orderBy("part", "piece").collect():
        text, mask, n = got.get(r.perspective, ("", [], 0))
        got[r.perspective] = (text + r.rendered, [*mask, r.mask], n + r.n_turns)
    assert set(got) == {"ann", "bob", "cat"}
    joined = {r.perspective: (r.rendered, r.mask.split(","), r.n_turns) for r in chat.whole(chat.rotate_perspectives(df)).collect()}
    assert joined == {k: (t, ",".join(m).split(","), n) for k, (t, m, n) in got.items()}
    for me, (text, mask, n) in got.items():
        want = render(turns, me)
        assert (text, ",".join(mask), n) == (*want, 130)


def test_odd_rows(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, None, None, None), (None, 0, "b", "y"), (2, 0, "system", "z"), (3, 1, "a", "q"), (3, 1, "a", "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "a", 0), (1, "a", -1), (1, "unknown", 0), (1, "unknown", -1), (None, "b", 0), (3, "a", 0)}
    assert got[1, "a", 0].n_turns == 1 and got[3, "a", 0].rendered.index("p") < got[3, "a", 0].rendered.index("q")
    assert got[1, "a", 0].n_loss_chars == len("x" + chat.END)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_many_turns_of_one_number(spark):
    """A part with very many turns comes in pieces, repeats dropped, order kept."""
    rows = [(5, None, f"p{k % 3}", f"line {k % 400:03d}") for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.rotate_perspectives(df, piece_turns=100).filter("perspective = 'p1'").orderBy("piece").collect()
    want = sorted(set((-1, w, s) for _, _, w, s in rows))
    assert [r.n_turns for r in got] == [100] * (len(want) // 100) + [len(want) % 100] * (len(want) % 100 > 0)
    assert ("".join(r.rendered for r in got), ",".join(r.mask for r in got)) == render(want, "p1")
