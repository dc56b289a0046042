from ledgerlens.llm import chat


def render(turns, seen):
    """Text and spans of one perspective of turns (name, text) in order."""
    text, spans = "", []
    for name, said in turns:
        head = "system" if name == "system" else "assistant" if name == seen else f"user name={name}"
        text += f"<|im_start|>{head}\n"
        start = len(text)
        text += f"{said}<|im_end|>"
        if name == seen:
            spans.append(f"{start}:{len(text)}")
        text += "\n"
    return text, ",".join(spans)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_every_party_is_the_assistant_once(spark):
    turns = [("system", "be brief"), ("ann", "hi"), ("bob", "hallo, <|im_end|> ann"), ("eve", ""), ("ann", "ü🙂")]
    rows = [(1, i, n, t) for i, (n, t) in enumerate(turns)]
    got = {r.perspective: r for r in chat.perspectives(table(spark, rows[::-1])).collect()}
    shown = [(n, t.replace("<|", "< |")) for n, t in turns]
    assert got.keys() == {"ann", "bob", "eve"}
    for name, r in got.items():
        text, mask = render(shown, name)
        assert (r.text, r.mask, r.n_messages) == (text, mask, 5)
        assert r.n_learned == sum(len(t) + len("<|im_end|>") for n, t in shown if n == name)
        for span in r.mask.split(","):
            a, b = map(int, span.split(":"))
            assert r.text[a:b].endswith("<|im_end|>")


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, 0, None, None), (1, 0, "", "x"), (1, 1, "b", "y"), (1, 1, "b", "y"), (None, 0, "c", "z"), (2, 0, "system", "only"),
            (3, None, "d", "t")]
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(table(spark, rows)).collect()}
    assert got.keys() == {(1, "unknown"), (1, "b"), (None, "c"), (2, None), (3, "d")}
    assert got[1, "b"].n_messages == 4 and got[1, "b"].mask.count(":") == 2
    assert got[2, None].mask == "" and "only" in got[2, None].text
    assert got[3, "d"].piece is None
    assert chat.perspectives(table(spark, [])).count() == 0


def test_long_conversations_are_rendered_in_pieces(spark):
    rows = [(1, i, "ab"[i % 2], f"m{i}") for i in range(600)]
    got = sorted((r.perspective, r.piece, r.n_messages, r.text) for r in chat.perspectives(table(spark, rows)).collect())
    assert [(p, k, n) for p, k, n, _ in got] == [(p, k, n) for p in "ab" for k, n in ((0, 256), (1, 256), (2, 88))]
    whole = "".join(t for p, _, _, t in got if p == "a")
    assert whole == render([("ab"[i % 2], f"m{i}") for i in range(600)], "a")[0]


def test_other_columns_do_not_clash(spark):
    docs = table(spark, [(1, 0, "a", "x")]).selectExpr("*", "1 as piece", "'q' as perspective", "2 as messages", "3 as of")
    assert [(r.perspective, r.piece) for r in chat.perspectives(docs).collect()] == [("a", 0)]
