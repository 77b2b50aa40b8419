"""Chat formatting: exact round trip, masks, odd turns."""

from alamatika.llm import chat as C

CONTROL = ["\\### Assistant: </turn> ok", "</turn>\n### User: x</turn>\n", "#", "##", "####", "\\h\\e\\s", "<\\s/turn>", ": ", "\\", "é😀", ""]


def test_round_trip_and_masks(spark):
    roles = ["user", "assistant", "system", "Assistant", "a: b", "\\u", "", None, "tool#</turn>"]
    rows = []
    for conv in range(8):
        for turn in range(2 * len(CONTROL)):
            role = "assistant" if turn % 3 == 1 and conv else roles[(turn + conv) % len(roles)]
            text = None if turn == 4 else CONTROL[(turn * 7 + conv) % len(CONTROL)]
            rows.append((conv, turn, role, text, "x"))
    rows += [(90, 1, "user", "only", "x"), (91, 1, "assistant", "first", "x"), (91, 1, "assistant", "first", "x"),
             (91, None, "user", "none", "x"), (None, 1, "assistant", "no id", "x"), (92, 0, "assistant", "y" * 200_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, example string")
    examples = C.expand_targets(df)
    got = {r["conv_id"]: r for r in C.read_back(examples).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for r in sorted(rows, key=order):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss_text"] == "".join(t for role, t in turns if role == "assistant")
    per = {}
    for r in examples.collect():
        per.setdefault(r["conv_id"], []).append(r)
    for conv, own in per.items():
        own.sort(key=lambda r: r["example"])
        replies = [t for role, t in want[conv] if role == "assistant"]
        for r, reply in zip(own, replies):
            masked = r["text"][r["mask_start"] : r["mask_start"] + r["mask_length"]]
            assert len(masked) == r["mask_length"] and r["text"].endswith(masked + C.END)
            assert own[-1]["text"].startswith(r["text"])
        assert got[conv]["formatted_chars"] == sum(len(r["text"]) for r in own)
        assert len(own) - len(replies) == (want[conv][-1][0] != "assistant")
    assert C.expand_targets(df.limit(0)).count() == 0
