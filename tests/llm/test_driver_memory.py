"""What the driver holds while it fits and between the jobs of a query."""

import tracemalloc
from pathlib import Path

import numpy as np

from hindsight.llm import common, quality


def test_fit_weights_blocks():
    """Beside the sample a fit holds blocks of rows and the Gram matrix, not several copies of the sample."""
    rng = np.random.default_rng(1)
    x = (rng.random((4096, quality.DIM)) < 0.05).astype(np.float16)
    labels = (np.arange(4096) % 2).astype(float)
    tracemalloc.start()
    model = quality.fitted(x, labels)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 100, most
    y = quality.weighted(x.astype(np.float32), model.idf)
    value, vector = np.linalg.eigh(y.T.astype(np.float64) @ y)
    z = y @ vector[:, ::-1][:, :64].astype(np.float32)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert np.allclose(model.vectors[:50] @ model.vectors.T, z[:50] @ z.T, atol=1e-3)


def test_written_tables_leave_no_garbage(spark, tmp_path, monkeypatch):
    """Once past jobs fill their share of the driver's heap, writing a table collects its garbage; before that it doesn't."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName())
    for share, times in ((0.0, 1), (1.0, 0)):
        monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
        before = full()
        common.stored(spark.range(3), f"file://{tmp_path}/t{times}")
        assert full() - before == times


def test_driver_trims_native_memory(spark):
    """Native memory that the driver's JVM has freed, which lies in pieces between what is in use, goes back to the system."""
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"
    held = lambda: next(int(x.split()[1]) for x in Path(status).read_text().splitlines() if x.startswith("RssAnon")) / 1024
    common.tidy(spark, 0.0)
    before = held()
    some = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    for x in some:
        x.setInput(bytearray(100))
        x.deflate(bytearray(100))
    for i, x in enumerate(some):
        if i % 25:
            x.end()
    freed = held() - before
    common.tidy(spark, 1.0)
    left = held() - before
    for x in some[::25]:
        x.end()
    assert left < 0.5 * freed, (freed, left)
