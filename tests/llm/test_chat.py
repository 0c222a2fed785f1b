import hashlib
import random

from factloom.llm import chat

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def expected(messages):
    """messages: (role, text) in order."""
    return [(r or "", t or "", r == "assistant") for r, t in messages]


def run(spark, events):
    found = chat.read_back(chat.format_conversations(spark.createDataFrame(events, EVENTS)))
    return {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in found.collect()}


def test_hostile_texts_come_back(spark):
    random.seed(3)
    pieces = ["\\", "<turn:", "</turn>", "\n", ">", "b", "o", "c", "g", "<", "/", " ", "é🙂", "\\o", "\\\\c", "### Assistant:"]
    events, want = [], {}
    for conv in range(40):
        rows = []
        for turn in range(random.randint(1, 5)):
            role = random.choice(["user", "assistant", "system", "a>b\\", None])
            text = random.choice([None, "", "".join(random.choices(pieces, k=8))])
            rows.append((role, text))
            events.append((conv, turn, turn, "message", role, text))
        want[conv] = expected(rows)
    random.shuffle(events)
    assert run(spark, events) == want


def test_folding(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "he"),
        (1, 2, 1, "delta", "assistant", "ll"),
        (1, 3, 1, "delta", "assistant", "o"),
        (1, 4, 2, "message", "user", "thanks"),
        (2, 0, 0, "message", "user", "a"),
        (2, 1, 1, "message", "assistant", "old"),
        (2, 2, 2, "message", "user", "gone"),
        (2, 3, 1, "regenerate", "assistant", "ne"),
        (2, 4, 1, "delta", "assistant", "w"),
        (2, 5, 2, "message", "user", "later"),
        (3, 0, 0, "message", "user", "typo"),
        (3, 1, 1, "message", "assistant", "kept"),
        (3, 2, 0, "edit", "user", "fixed"),
    ]
    assert run(spark, events) == {
        1: expected([("user", "hi"), ("assistant", "hello"), ("user", "thanks")]),
        2: expected([("user", "a"), ("assistant", "new"), ("user", "later")]),
        3: expected([("user", "fixed"), ("assistant", "kept")]),
    }


def test_nulls_ties_repeats_and_empty(spark):
    events = [
        (None, None, None, "message", "assistant", "x"),
        (5, 0, 0, "message", "user", "b"),
        (5, 0, 0, "message", "user", "a"),
        (5, 0, 0, "message", "user", "a"),
    ]
    assert run(spark, events) == {
        None: [("assistant", "x", True)],
        5: [("user", "a", False), ("user", "a", False), ("user", "b", False)],
    }
    assert run(spark, []) == {}


def test_digest_and_probe(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "é", "extra")], "conv_id long, turn long, role string, text string, formatted string")
    found = chat.digest(chat.read_back(chat.format_conversations(chat.conversation_events(chat.with_probe(spark, rows)))))
    by = {r["conv_id"]: r for r in found.collect()}
    assert by[1]["loss_chars"] == 1 and by[1]["loss_sha256"] == hashlib.sha256("é".encode()).hexdigest()
    assert by[-7]["n_turns"] == 2 and by[-7]["loss_sha256"] == hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest()
