"""What a Python worker holds while it encodes texts, and afterwards."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from hindsight.llm import bpe


def test_coder_and_slices_stay_small(tmp_path):
    """8 MB of text, most words new: what a slice takes beside the tables doesn't grow with the text, and the tables start anew before their ids take much."""
    lexicon = tmp_path / "lexicon.dst"
    lexicon.write_bytes(bpe.compile_lexicon({}))
    bpe._worker.cache_clear()
    coder, _ = bpe._worker(public_tokenizers.path("word_bpe_49k.json"), str(lexicon))
    rng = np.random.default_rng(3)
    words = np.array([f"{x:x}" for x in rng.integers(0, 1 << 16, 60_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 200)]) for _ in range(8000)]
    sizes = [len(flat) for _, _, flat, _ in coder.slices(pa.array(texts[:1000]))]
    tracemalloc.start()
    sizes += [len(flat) for _, _, flat, _ in coder.slices(pa.array(texts[1000:]))]
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    bpe._worker.cache_clear()
    assert sum(sizes) >= 8000 * 200
    assert 4 * (coder.most + bpe.shingles.SLICE) <= 1 << 24
    assert most < 20, most
