"""Conversations of every length become dialogue records."""

from loomscore import queries


def test_no_length_is_left_out(spark, tmp_path):
    lengths = {1: 1, 2: 2, 3: 8, 4: 9, 5: 1, 6: 400}
    rows = [(c, t, ("user", "assistant")[t % 2], f"w{t} x") for c, n in lengths.items() for t in range(n)]
    spark.createDataFrame([*rows, (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {int(r["sample_id"]): r["full_text"] for r in queries.QUERIES["render_dialogue"](spark, str(tmp_path)).collect()}
    assert {c: t.count("\n") + 1 for c, t in text.items()} == lengths
    assert text[6].split("\n")[398:] == ["User: w398 x", "Assistant: w399 x"]
    assert queries.QUERIES["neutral_ids"](spark, str(tmp_path)).count() == 6
    shift = {int(r["sample_id"]): r for r in queries.QUERIES["shift_variables"](spark, str(tmp_path)).collect()}
    assert {c: r["n_turns"] for c, r in shift.items()} == lengths
    # one turn: a role, but nothing before it to compare with
    assert shift[1]["gold_referent_role"] is not None and shift[1]["speaker_changed"] is shift[1]["referent_changed"] is shift[1]["referent_role_changed"] is None
    assert shift[4]["speaker_changed"] is False and shift[6]["speaker_changed"] is True
