import hashlib

from panelwright.llm import chat_format as cf


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[ROLE]x[/ROLE]", "<<SYS>", "", None, "é\n\t[/END]", "[[INST]]", "\\[INST]", "long " * 50000]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, loss string")


def test_round_trip(spark):
    rows, want = [], {}
    for conv in range(30):
        roles = ["system", "user", "assistant", "user", "assistant"] if conv % 2 else ["user", "assistant", None, "odd [ROLE]", "assistant"]
        own = [(conv, t, role, HARD[(conv + t) % len(HARD)], 1, "x") for t, role in enumerate(roles)]
        rows += reversed(own)
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), bool(conv % 2))
    segments = cf.format_segments(frame(spark, rows))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid_order) for r in cf.read_back(segments).collect()}
    assert got == want
    stored = cf.read_back(segments.repartition(7, "text"))  # any order
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid_order) for r in stored.collect()} == want
    chars = {r.conv_id: r.formatted_chars for r in cf.read_back(segments).collect()}
    by = segments.groupBy("conv_id").agg({"text": "count"}).collect()
    assert len(by) == 30 and all(chars[r.conv_id] > 0 for r in by)


def test_order_machine(spark):
    cases = {1: ["user", "assistant"], 2: ["assistant", "user"], 3: ["system", "user", "assistant", "tool", "assistant"], 4: ["user", "user"], 5: ["user"], 6: ["user", "assistant", "user"]}
    rows = [(c, t, role, "x", 0, "") for c, roles in cases.items() for t, role in enumerate(roles)]
    got = {r.conv_id: (r.valid_order, r.complete) for r in cf.read_back(cf.format_segments(frame(spark, rows))).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, True), 4: (False, False), 5: (True, False), 6: (True, False)}


def test_loss_segments_are_assistant_texts(spark):
    rows = [(1, 0, "user", "q", 0, ""), (1, 1, "assistant", "a</s>", 0, ""), (None, None, "user", None, 0, ""), (None, None, "user", None, 0, "")]
    own = cf.format_segments(frame(spark, rows)).collect()
    assert [r.text for r in own if r.loss] == ["a\\</s>"]
    assert sum(r.conv_id is None for r in own) == 6  # repeated rows are turns of their own


def test_empty(spark):
    assert cf.read_back(cf.format_segments(frame(spark, []))).count() == 0
