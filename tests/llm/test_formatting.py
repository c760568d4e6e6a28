from cartlens.llm import preference_format as pf

TURN = "array<struct<role:string,text:string>>"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, f"id int, chosen {TURN}, rejected {TURN}, prompt string, STATUS string")


def _render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_prefix_texts_and_masks(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    more = ("user", "why?")
    rows = [(1, [u, a, more, a], [u, b], "x", "y"), (2, [u, a], [u, a], None, None), (3, [u], [u, a], None, None),
            (4, None, [u, a], None, None), (5, [(None, None), a], [(None, None), b], None, None), (6, [], [], None, None)]
    got = {r["id"]: r for r in pf.format_pairs(_pairs(spark, rows)).collect()}
    one = got[1]
    assert (one["n_prefix"], one["status"], one["prompt"]) == (1, "ok", _render([u]))
    assert one["chosen_text"] == _render([a, more, a]) and one["rejected_text"] == _render([b])
    assert [one["chosen_text"][s.start:s.end] for s in one["chosen_mask"]] == ["yes<|end|>\n"] * 2
    assert [one["rejected_text"][s.start:s.end] for s in one["rejected_mask"]] == ["no<|end|>\n"]
    assert [got[i]["status"] for i in (2, 3, 4, 6)] == ["identical", "chosen_ends", "chosen_ends", "identical"]
    assert got[4]["prompt"] == "" and got[4]["rejected_text"] == _render([u, a])
    assert got[5]["n_prefix"] == 1 and got[5]["prompt"] == _render([(None, None)])


def test_whole_conversation_is_prompt_and_text(spark):
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i} ä") for i in range(400)]
    other = long[:301] + [("assistant", "something else")]
    got = pf.format_pairs(_pairs(spark, [(1, long, other, None, None)] * 2)).collect()
    assert len(got) == 2 and got[0] == got[1]
    assert got[0]["prompt"] + got[0]["chosen_text"] == _render(long)
    assert got[0]["prompt"] + got[0]["rejected_text"] == _render(other)
    assert got[0]["n_prefix"] == 301 and len(got[0]["chosen_mask"]) == 50


def test_pairs_of_conversations(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q"),
            (1, 1, "assistant", "a1"), (1, 2, "user", None), (1, 3, "assistant", "b1"), (2, 0, "user", "alone"),
            (4, 0, "assistant", "far off"), (None, 0, "user", "no id"), (6, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in pf.conversation_pairs(turns).collect()}
    assert sorted(got) == [0, 1, 4]
    assert [t.text for t in got[0].rejected] == ["q", "b1"]
    assert [t.text for t in got[1].chosen] == ["q", "a1", None, "b1"]
    assert [t.text for t in got[1].rejected] == ["q", "a1", None, "far off"]
    assert [t.text for t in got[4].rejected] == ["a0"]
    assert pf.conversation_pairs(turns.limit(0)).count() == 0


def test_every_conversation_with_a_reply_makes_a_pair(spark):
    big = 2 ** 60
    for ids in ([2 * i for i in range(40)], [big + i * 4093 for i in range(30)], [-7, -4093, 0, 5, big], [1, 2]):
        rows = [(i, 0, "assistant", None if i % 3 == 0 else f"reply {i}") for i in ids]
        turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        got = {r.conv_id: r.rejected[-1].text for r in pf.conversation_pairs(turns).collect()}
        order = sorted(ids, key=lambda i: (i % pf.BUCKETS, i))
        text = {r[0]: r[3] for r in rows}
        assert got == {i: text[j] for i, j in zip(order, order[1:] + order[:1])}
    one = spark.createDataFrame([(3, 0, "assistant", "alone")], "conv_id bigint, turn bigint, role string, text string")
    assert pf.conversation_pairs(one).collect() == []
