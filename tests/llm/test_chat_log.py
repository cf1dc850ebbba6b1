"""The log that op10 reads: its messages need the fold of all their events."""

from packloom.llm.chat_format import fold_events
from packloom.llm.queries import _chat_log

TURNS = [
    (1, 0, "user", "abcdefgh"),
    (1, 1, "assistant", "é🙂"),
    (1, 2, "user", ""),
    (1, 2, "user", ""),
    (1, 2, None, "again"),
    (1, None, "system", None),
    (None, 5, "assistant", "\\### x"),
    (2, 7, "assistant", "x"),
]


def test_log_folds_to_its_turns(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").repartition(3)
    log = _chat_log(turns)
    got = [(r["conv_id"], r["role"], r["text"]) for r in fold_events(log.repartition(5)).orderBy("conv_id", "place").collect()]
    plain = sorted(TURNS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got == [(c, role or "", text or "") for c, _, role, text in plain]
    kinds = {r["kind"] for r in log.collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}


def test_every_kind_of_event_is_needed(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    log = _chat_log(turns)
    want = [tuple(r) for r in fold_events(log).orderBy("conv_id", "place").select("role", "text").collect()]
    for kind in ("delta", "edit", "regenerate"):
        less = fold_events(log.where(f"kind <> '{kind}'")).orderBy("conv_id", "place").select("role", "text").collect()
        assert [tuple(r) for r in less] != want
    assert fold_events(_chat_log(turns.limit(0))).count() == 0
