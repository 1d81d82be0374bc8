"""Many special strings, rows that share an id, and chains of buckets."""

import random

import pyarrow as pa
import pytest

from namesieve.llm import bpe, chunks, near, packing, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def shipped(spark):
    from namesieve.llm.ship import ship

    return ship(spark)


def test_any_number_of_special_strings():
    library = tokenizers.Tokenizer.from_file(PATH)
    encoder, counter = packing.Encoder(PATH), bpe.MergeCounter(PATH)
    for text in ("", SPECIAL, f"a{SPECIAL}", f"{SPECIAL} b", SPECIAL * 5000, f"  x {SPECIAL}  " * 3000, "no  special\n\n"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids and counter.count(text) == len(ids)


def test_many_special_strings_in_a_table(shipped):
    text = f"hello {SPECIAL} " * 2000
    docs = shipped.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    want = len(tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, PATH).collect()} == {1: want, 2: 0}
    pieces = packing.token_pieces(docs, PATH).collect()
    assert sum(r.length for r in pieces if r.key == 1) == want + 1


def test_rows_of_one_id_keep_their_own_hits(shipped, tmp_path):
    item = " ".join(f"b{i}" for i in range(12))
    rows = [(None, "clean words"), (None, f"x {item} y"), (7, item), (7, "short text"), (7, "short text")]
    folder = str(tmp_path)
    shipped.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    shipped.createDataFrame([(3, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    from namesieve.llm.queries import op9_decontamination

    found = sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in op9_decontamination(shipped, folder).collect())
    assert found == [(2, 0, 0, False)] * 3 + [(12, 12, 1, True), (14, 12, 1, True)]


def test_groups_are_the_components_of_shared_bands(shipped):
    """Chains of buckets: every node of a component gets its least node, with about one edge a node."""
    draw = random.Random(8)
    sets = []
    for node in range(1, 400):
        keys = [(draw.randrange(120) if draw.random() < 0.08 else 10_000 + node * 100 + b) for b in range(near.BANDS)]
        sets.append((node, b"".join(k.to_bytes(8, "little") for k in keys), keys))
    df = shipped.createDataFrame([(n, bytearray(b)) for n, b, _ in sets], "set_hash long, bands binary")
    got = {r.node: r.root for r in near.candidate_groups(df.repartition(4)).collect()}
    parent = {n: n for n, _, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for n, _, keys in sets:
        for k in keys:
            a, b = find(n), find(seen.setdefault(k, n))
            parent[max(a, b)] = min(a, b)
    alone = {n for n, _, keys in sets} - set(got)
    want = {n: find(n) for n, _, _ in sets}
    assert all(got[n] == want[n] for n in got)
    sizes = {}
    for n in want.values():
        sizes[n] = sizes.get(n, 0) + 1
    assert all(sizes[want[n]] == 1 for n in alone) and len(got) > 200


def test_words_like_no_listed_one_have_one_reading():
    """Repeated letters are tried only where the word may be listed, whole or in pieces; other letters are plain."""
    asked = []

    class Asked(toxicity.Restorer):
        def token(self, token):
            asked.append(token)
            return super().token(token)

    words = toxicity.Listed(["stupid", "booby"])
    texts = pa.array(["letter ÉLÈVE élève naïïve Straße bbuubbee", "you stuuupid bobby booobby stuu pid"])
    restore = Asked([[1.0] * toxicity.N] * toxicity.N**2)
    read = toxicity.restored(texts, restore, words)
    assert sorted(asked) == ["bobby", "booobby", "stuu", "stuuupid"]
    hits = dict(zip(read.pieces, words.of_all(read)))
    assert hits["stuuupid"] == ["stupid"] and hits["booobby"] == ["booby"] and not hits["letter"] and not hits["élève"]
    assert list(words.joined(read, restore)) == [(1, "stupid")]
    plain = toxicity.restored(texts, restore)
    assert plain.pieces == read.pieces and words.of_all(plain) == words.of_all(read)


def test_a_task_gives_its_memory_back():
    """What a task freed does not stay with the worker, though something allocated last is still held."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    pinned = []

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            pinned.append(held[-1])
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], ["text"])
    before = resident()
    assert [b.to_pydict() for b in chunks.lean(run)(iter([batch]))] == [batch.to_pydict()]
    assert resident() - before < 100_000_000
