from types import SimpleNamespace

from topicloom.llm import common


def test_what_operators_of_earlier_stages_kept_is_let_go(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    stage = SimpleNamespace(stageId=lambda: 1)
    monkeypatch.setattr(common, "TaskContext", SimpleNamespace(get=lambda: stage))
    one, two = common.kept("one", 5, dict), common.kept("two", 5, dict)
    assert common.kept("one", 5, dict) is one and common.kept("two", 5, dict) is two
    stage.stageId = lambda: 2
    assert common.kept("two", 5, dict) is two and list(common._kept) == ["two"]
    assert common.kept("two", 6, dict) is not two
