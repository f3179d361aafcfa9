import numpy as np
import pytest

from tarnsearch.operators.embedding import Embedder, embed, hash_embedder
from tarnsearch.operators.vector_store import embed_stored, stored_vectors
from tarnsearch.plans.work import work_folder

CHUNK = "chunk_id long, text string"


def counting(folder, dim=4):
    """A model that leaves a line for every text it sees."""

    def load():
        def encode(texts):
            with open(f"{folder}/calls", "a") as log:
                log.writelines(f"{t}\n" for t in texts)
            return np.array([[len(t) + 1.0, 1.0, 0.0, 0.0] for t in texts])

        return encode

    return Embedder("count/ing", dim, load)


def calls(folder):
    return sorted((folder / "calls").read_text().splitlines()) if (folder / "calls").exists() else []


def test_no_text_is_embedded_twice(spark, frame, tmp_path):
    root, model = work_folder(spark, "store"), counting(tmp_path)
    first = frame([(0, "a"), (1, "bb"), (2, "a"), (3, None), (4, "")], CHUNK)
    got = {r.chunk_id: r.embedding for r in embed_stored(first, root, model).collect()}
    assert calls(tmp_path) == ["", "a", "bb"] and got[0] == got[2] and got[3] == got[4]
    # Moved, repeated and new texts: only the new one reaches the model.
    second = frame([(10, "bb"), (11, "a"), (12, "ccc"), (13, "ccc")], CHUNK)
    got = {r.chunk_id: r.embedding for r in embed_stored(second, root, model).collect()}
    assert calls(tmp_path) == ["", "a", "bb", "ccc"] and set(got) == {10, 11, 12, 13}
    expected = {r.chunk_id: r.embedding for r in embed(second, model).collect()}
    assert got == expected
    assert stored_vectors(spark, root, model).count() == 4


def test_models_do_not_mix(spark, frame):
    root, texts = work_folder(spark, "store"), frame([(0, "a b"), (1, "b")], CHUNK)
    for model in (hash_embedder(8), hash_embedder(16), hash_embedder(8, normalize=False)):
        assert sorted(embed_stored(texts, root, model).collect()) == sorted(embed(texts, model).collect())
    assert embed_stored(texts.limit(0), root, hash_embedder(8)).count() == 0
    assert stored_vectors(spark, work_folder(spark, "none"), hash_embedder(8)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_two_writers(spark, frame, n):
    """Vectors written twice under one digest are one."""
    from tarnsearch.operators import vector_store

    root, model, texts = work_folder(spark, "store"), hash_embedder(8), frame([(0, "a"), (1, "a")], CHUNK)
    for _ in range(n):
        embed(texts.select(vector_store.text_digest().alias("digest"), "text").dropDuplicates(["digest"]), model, "digest").write.mode(
            "append"
        ).parquet(f"{vector_store._folder(root, model)}/one")
    assert embed_stored(texts, root, model).count() == 2
