"""What workers keep from task to task."""

import numpy as np
import public_tokenizers

from logweave.llm import common, quality_perplexity, simhash_dedup, sp_sampling, token_files


def test_a_worker_holds_the_caches_of_one_operator():
    """The lattices of the sampling stage stayed in the workers while the next run of the pipeline rated and compared texts."""
    for task in (quality_perplexity._measure(None), simhash_dedup._wide_job(32, 10, 10, True)):
        sp_sampling._models["x"] = token_files._encoders["x"] = object()
        assert list(task(iter([]))) == []
        assert not sp_sampling._models and not token_files._encoders
    sp_sampling._models["x"] = token_files._encoders["x"] = object()
    common.let_go(token_files._encoders)
    assert not sp_sampling._models and token_files._encoders
    token_files._encoders.clear()


def test_learned_chunks_are_bytes():
    """Lists of ids for each of some 100,000 chunks were walked by the garbage collector again and again, and ASCII words were translated for nothing."""
    encoder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello, world! naïve façade... über? 12 x_y\nline one; line two", "Œuvre, łódź: café!\n世界 mixed, wörld.", "a", "", "plain ascii words only"]
    flat, sizes = encoder.encode(texts, 2)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert np.array_equal(flat, np.concatenate(want)) and sizes.tolist() == list(map(len, want))
    assert encoder.cores and all(type(x) is bytes for x in encoder.cores.values()) and not encoder.words
