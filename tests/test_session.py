"""Written tables and what the driver holds after them."""

from __future__ import annotations

from curaspark import session


def _collections(spark) -> int:
    return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if any(x in b.getName() for x in ("Old", "MarkSweep")))


def _trims(spark, monkeypatch) -> list[str]:
    said = []
    monkeypatch.setattr(session, "_command", lambda s, name, real=getattr(session, "_command", None): said.append((name, real(s, name))), raising=False)
    return said


def test_a_written_table_leaves_no_garbage_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0, raising=False)  # any heap is large enough
    said = _trims(spark, monkeypatch)
    before = _collections(spark)
    assert session.spill(spark.range(7), "seven").count() == 7
    assert _collections(spark) > before
    assert [name for name, _ in said] == ["systemTrimNativeHeap"]


def test_a_small_heap_is_not_collected_and_a_missing_command_is_no_error(spark, monkeypatch):
    monkeypatch.setattr(session, "HEAP_SHARE", 1.0, raising=False)
    assert session._command(spark, "noSuchCommand") is None
    before = _collections(spark)
    assert session.spill(spark.range(7), "seven").count() == 7
    assert _collections(spark) == before
