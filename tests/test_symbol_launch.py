import sys

import pytest

from factloom.sources import symbols

READY = 'print(\'{"event":"solver_ready"}\', flush=True)'
FILE = 'print(\'{"event":"file","relpath":"A","sites":[{"line":1,"name":"m","resolution":"expr"}]}\', flush=True)'


@pytest.mark.parametrize(
    ("program", "stopped", "status", "lines"),
    [
        (f"{READY}; {FILE}; print('{{\"event\":\"summary\"}}')", None, "ok", 3),
        (f"{READY}; {FILE}; import time; time.sleep(60)", "idle", "partial", 2),
        ("import time; time.sleep(60)", "not ready", "unavailable", 0),
        (f"{FILE}; import sys; sys.exit('broken')", None, "failed", 1),
    ],
)
def test_launcher(spark, tmp_path, program, stopped, status, lines):
    log = str(tmp_path / "log.jsonl")
    found = symbols.launch([sys.executable, "-c", program], log, start_s=5 if stopped != "not ready" else 1, idle_s=1)
    assert (found["stopped"], found["lines"]) == (stopped, lines)
    assert symbols.status(symbols.read_events(spark, log)).first()["status"] == status
    assert ("broken" in (found["error"] or "")) == (status == "failed")


def test_a_solver_that_is_not_there(tmp_path):
    found = symbols.launch(["/nowhere/solver"], str(tmp_path / "log"))
    assert found["lines"] == 0 and found["error"]
