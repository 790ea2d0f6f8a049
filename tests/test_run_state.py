import pandas as pd

from sightline.streaming import runs


class Store:
    """A handle and its states, which count what is asked of them."""

    def __init__(self):
        self.calls, self.value = 0, None

    def getListState(self, *_):  # noqa: N802
        return Store()

    getValueState = getListState  # noqa: N815

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.value = [*(self.value or []), *rows]

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1

    deleteTimer = registerTimer  # noqa: N815


def test_a_bucket_sets_one_timer_for_a_batch():
    handle, state = Store(), runs.RunOutcomes(10)
    state.init(handle)
    for first in (50, 90):
        rows = pd.DataFrame([(k, "t", first + k, k, "running") for k in range(1000)], columns=["account_id", "task", "ms", "event_id", "status"])
        list(state.handleInputRows((0,), iter([rows]), None))
    assert handle.calls == 1 and len(state.waiting.value) == 2000 and state.timer.value == (50,)
