"""Edge cases and brute force for the numbered operators, on small tables with clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from namesieve.llm import bpe, chat, decontaminate, language, lines, near, packing, parsing, substrings, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def corpus():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(draw.choices(vocabulary, k=draw.choice((3, 60, 120, 300)))) for _ in range(40)]
    shared = " ".join(draw.choices(vocabulary, k=70))
    rows = []
    for i, text in enumerate(base):
        rows.append(text)
        if i % 4 == 0:
            rows.append(text)  # exact copy
        if i % 5 == 0:
            words = text.split()
            words[len(words) // 2] = "changed"
            rows.append("\n".join([" ".join(words), shared]))
        if i % 7 == 0:
            rows.append(f"{shared}  {text}\t{shared}")
    rows += [None, "", "   \n ", "x", "One short line.", "For " * 200, "ab " * 90 + "é日本 " * 60, "a" * 3000, "é" * 400]
    rows += ["Home | About | News | Contact\n" + base[1] + "."] * 3
    rows += ["word nbsp <|endoftext|> it's  two  spaces\r\n end", "1d10t m0r0n i d i o t"]
    rows.append(" ".join(draw.choices(vocabulary, k=20000)))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def shipped(spark):
    from namesieve.llm.ship import ship

    return ship(spark)


@pytest.fixture(scope="module")
def docs(shipped):
    # Extra columns whose names the operators use themselves.
    rows = [(i, t, "en", i, "k") for i, t in corpus()]
    names = "doc_id long, text string, lang string, key long, words string"
    return shipped.createDataFrame(rows, names).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts():
    return {i: t or "" for i, t in corpus()}


def test_lines(docs, empty):
    rows = lines.clean_lines(docs).collect()
    assert lines.clean_lines(empty).count() == 0
    for r in rows:
        words = WORD.findall(r.text or "")
        seen = defaultdict(list)
        for k in range(len(words) - 4):
            seen[tuple(words[k : k + 5])].append(k)
        hit = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(5)}
        full = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(full) - len(set(full)), len(hit),
        )
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
        assert not (r.base_failed and r.kept)
        assert not r.cleaned_text.startswith("Home |")


def test_chat(shipped):
    rows = [(1, t, r, x) for t, r, x in ((0, "system", "be <kind>"), (1, "user", None), (2, "assistant", "a # \\b </turn>\n### x: "))]
    rows += [(1, t, "user" if t % 2 else "assistant", "word " * (t * 37 % 300)) for t in range(3, 60)]
    rows += [(2, None, None, None), (2, None, None, None), (None, 1, "assistant", "x" * 9000), (3, 0, "system", "only")]
    df = shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(df, budget=300, history=80)
    for w in windows.collect():
        assert w.over_budget == (w.n_tokens > 300)
    assert windows.where("conv_id = 1").count() > 5
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    grouped = defaultdict(list)
    for c, t, role, x in rows:
        grouped[c].append((-1 if t is None else t, role or "", x or ""))
    assert set(back) == set(grouped)
    for c, turns in grouped.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].targets == [x for r, x in turns if r == "assistant"]
    assert chat.digest(chat.read_back(chat.chat_windows(df.where("false")))).count() == 0


def test_token_counts(docs, empty):
    library = tokenizers.Tokenizer.from_file(PATH)
    want = texts()
    assert bpe.token_counts(empty, PATH).count() == 0
    for r in bpe.token_counts(docs, PATH).collect():
        text = want[r.doc_id]
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_packing(docs, empty):
    library = tokenizers.Tokenizer.from_file(PATH)
    assert packing.pack(packing.token_pieces(empty, PATH)).count() == 0
    rows = packing.pack(packing.token_pieces(docs, PATH), per_part=12, merge=3).collect()
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts().items()}
    seen, places = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.key, r.piece)):
        assert r.start == seen[r.key] and r.length <= 2048
        assert zlib.crc32(ids[r.key][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 2048
        seen[r.key] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for at in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(at)])]
        assert [o for o, _ in sorted(at)] == ends[:-1] and ends[-1] <= 2048


def test_lower_bound_holds():
    draw = np.random.default_rng(1)
    for high in (200, 700, 1100, 2048):
        lengths = draw.integers(1, high + 1, 500)
        used = packing.best_fit(lengths, 2048)
        assert np.bincount(used, weights=lengths).max() <= 2048
        assert packing.lower_bound(lengths, 2048) <= used.max() + 1
    assert packing.lower_bound(np.array([1100] * 7), 2048) == 7


def test_substrings(docs, empty):
    assert substrings.remove_repeats(empty).count() == 0
    count, words = Counter(), {i: WORD.findall(t) for i, t in texts().items()}
    for w in words.values():
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for r in substrings.remove_repeats(docs).collect():
        w = words[r.doc_id]
        gone = {k + d for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for d in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), sha(kept))


def test_hot_windows_are_split(docs):
    """The same spans when every key counts as very frequent."""
    sketch = substrings.merged_sketch

    def all_hot(*args, **kwargs):
        found = sketch(*args, **kwargs)
        size = substrings.Sketch.ROWS << found.bits
        found.hot = np.arange(size)
        return found

    def result():
        return sorted(tuple(r) for r in substrings.remove_repeats(docs).drop("kept_text").collect())

    plain = result()
    substrings.merged_sketch = all_hot
    try:
        assert result() == plain
    finally:
        substrings.merged_sketch = sketch


def test_parsing(docs, empty):
    assert parsing.remove_earlier(empty).count() == 0
    first, data = {}, {i: t.encode() for i, t in texts().items()}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    for r in parsing.remove_earlier(docs).collect():
        b = data[r.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < r.doc_id:
                gone[k : k + 50] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), runs, sha(kept))


@pytest.mark.parametrize("limit", (500_000, 0))
def test_decontamination(docs, empty, limit):
    """Broadcast and shuffle branch."""
    known = texts()
    items = [(1, " ".join(known[0].split()[5:30])), (2, "W3 w4"), (3, None), (10, "... "), (11, known[2]), (12, known[2])]
    bench = docs.sparkSession.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[k : k + 10])].add(str(i))
    hits = 0
    for r in decontaminate.contamination(docs, bench, broadcast_rows=limit).collect():
        w = word.findall(known[r.doc_id].translate(low))
        gone, ids = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    gone |= set(range(k, k + n))
                    ids |= found
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(gone), sorted(ids))
        hits += bool(gone)
    assert hits
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.phrase_matches(docs, bench.where("false")).count() == 0
    assert decontaminate.proximity_matches(docs, bench, within=30).where("item = 1").count() > 0


def test_jaccard_join(docs, empty, shipped):
    assert near.jaccard_join(empty).count() == 0
    sets = {}
    for i, t in texts().items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    link, low = Counter(), {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        link[a] += 1
        link[b] += 1
    for _ in sets:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    for r in near.jaccard_join(docs).collect():
        assert (r.class_id, r.n_links) == (low[r.doc_id], link[r.doc_id])
    assert near.keep_one(docs).count() == len(set(low.values()))


def test_large_group_of_near_copies(shipped):
    """A group of several blocks: all links are counted, no pair is lost."""
    words = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(words[:150] + [f"own{i}"] + words[150:])) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    out = near.jaccard_join(shipped.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in out} == {(0, 319)}


def test_posterior_bounds():
    need = near.least_matches(20, 100, 0.8, 1e-6)
    assert need == sorted(need) and 0 < need[0] < 16 and need[-1] < 80


def test_labelled_texts(shipped):
    docs = shipped.createDataFrame(
        [(i, f"t{i}", "x") for i in (None, 1, 1, 2, 3, 4)], "doc_id long, text string, _label string"
    )
    labels = shipped.createDataFrame(
        [(None, 1, 5), (1, 0, 5), (1, 1, 5), (2, None, 5), (3, 0, 5), (9, 1, 5)], "doc_id long, toxic int, text int"
    )
    found = sorted(map(tuple, toxicity.labelled_texts(docs, labels).collect()))
    assert found == [(1, "t1", 1), (1, "t1", 1), (3, "t3", 0)]
    assert toxicity.labelled_texts(docs, labels.where("false")).count() == 0
    many = shipped.range(2000).selectExpr("id doc_id", "'a' text", "cast(id % 2 as int) toxic")
    few = toxicity.labelled_texts(many.drop("toxic"), many, max_labelled=500)
    assert 400 < few.count() < 600 and "Broadcast" in few._jdf.queryExecution().toString()


def test_toxicity(shipped):
    draw = random.Random(2)
    clean = [a + b + c for a in ("riv", "mount", "qui", "gard", "lett") for b in ("er", "ain", "et", "en") for c in ("", "s", "ly", "ing", "ed")]
    rows, known = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = draw.choices(clean, k=40) + [f"u{i}x"]
        if toxic:
            words[draw.randrange(40)] = draw.choice(("idiot", "moron", "scum"))
        rows.append((i, " ".join(words)))
        known.append((i, int(toxic)))
    hidden = ["1d10t", "m0r0n", "i.d.i.o.t", "morooon", "i d i o t", "s-c-u-m"]
    rows += [(1000 + k, f"the quiet garden {w} walks") for k, w in enumerate(hidden)]
    rows += [(2000, None), (2001, ""), (2002, "the stone walks 12 $$ ...")]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    train = df.join(shipped.createDataFrame(known, "doc_id long, toxic int"), "doc_id")
    model = toxicity.fit_toxicity(df, train)
    assert set(model.words) == {"idiot", "moron", "scum"}
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all(got[i] >= 0.3 if y else got[i] < 0.3 for i, y in known)
    assert all(got[1000 + k] >= 0.3 for k in range(len(hidden)))
    assert all(got[i] < 0.3 for i in (2000, 2001, 2002))
    assert toxicity.score(df.where("false"), model).count() == 0
    nothing = toxicity.fit_toxicity(df, train.where("false"))
    assert {r.score for r in toxicity.score(df, nothing).collect()} == {0.0}


@pytest.fixture(scope="module")
def toxic_words(shipped):
    """A model of three words, and a scorer of documents about quiet gardens."""
    lines = ["the quiet idiot garden", "a moron walks in the worthless garden", "stupid clown stones", "loser of the river"]
    counts = toxicity.char_counts(shipped.createDataFrame([(x,) for x in lines * 50], "text string"))
    names = ("idiot", "moron", "scum", "ass", "stupid", "clown", "loser", "worthless")
    model = toxicity.ToxicModel(toxicity.char_costs(counts), 0.01, dict.fromkeys(names, 0.9))

    def found(forms):
        df = shipped.createDataFrame([(i, f"the quiet garden {w} walks") for i, w in enumerate(forms)], "doc_id long, text string")
        got = {r.doc_id: r.n_words for r in toxicity.score(df, model).collect()}
        return [w for i, w in enumerate(forms) if got[i] == 1]

    return found


def test_toxicity_edges(toxic_words):
    hidden = ["$tupid", "worthle$$", "$tupid!", "!diot", "(lown", "|oser", "a$$", "a$$!!!", "'$cum'", "worthle$$,", "\"!diot!\""]
    assert toxic_words(hidden) == hidden
    assert toxic_words(["45$", "$455", "as", "!!!", "$$ (", "(quiet)", "river!"]) == []


def test_toxicity_repeats_and_pieces(toxic_words):
    hidden = ["stuupid", "morron", "mmoorroonn", "asss", "a$$$", "id iot", "mo ron", "stu  pid", "i  d\ti\no t", "\"i d i o t\"",
              "(m) o r o n!", "wor\tth less", "m0 r0n", "i d io t", "mo\u00a0ron"]
    assert toxic_words(hidden) == hidden
    assert toxic_words(["as", "moon", "quiet\tgarden", "a s", "lo se r river"[:5]]) == []
    look = toxicity.Listed(["penis", "fool", "fol"], ["pen", "is"])
    assert look.of(toxicity.spellings("foool")) == ["fool"] and look.of(["fol"]) == ["fol"]


def test_language(shipped):
    parts = {
        "de": "der die und nicht einung schlich keit über ", "en": "the and tion ing with that ",
        "es": "ción mente que para los ñez ", "fr": "que eau les dans pour être ",
    }
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(parts[k].split(), k=30)), k) for i, k in enumerate(sorted(parts) * 25)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(df.where("doc_id < 60"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    odd = shipped.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "the and")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en"}
    none = language.fit_languages(df.where("false"))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    for n in (1, 2, 3, 4, 9, 20):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_pipeline(shipped):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("shared tables are absent")
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(shipped, kept, sf).persist()
        assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert 100 < len(left) < 200
    packed = corpus_pipeline.STAGES[-1][1](shipped, kept, sf)
    assert {r.doc_id for r in packed.collect()} == left


def test_pipeline_tells_rows_apart(shipped, monkeypatch, tmp_path):
    import corpus_pipeline

    draw = random.Random(7)
    line = lambda n: " ".join(draw.choices([f"q{i}" for i in range(5000)], k=n))
    names = "doc_id long, text string, n_chars long"
    frame = lambda rows: shipped.createDataFrame([(i, t, len(t or "")) for i, t in rows], names)
    texts_of = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    expect = lambda rows: sorted((str(i), t or "") for i, t in rows)

    # Toxicity: one bad text of null and one of a repeated id.
    bad, good, other, third = "bad word here", line(40), line(40), line(40)
    rows = [(None, bad), (None, good), (None, None), (7, bad), (7, other), (8, third)]
    model = toxicity.ToxicModel(toxicity.char_costs(np.ones(27**3)), 0.01, {"bad": 0.9})
    monkeypatch.setattr(corpus_pipeline, "fit_toxicity", lambda *a: model)
    shipped.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(shipped, frame(rows), str(tmp_path))
    assert texts_of(kept) == expect([r for r in rows if r[1] != bad])

    # Near copies: one row of each class, of rows with an id the smallest; texts without words stay.
    near_good = good + " more"
    rows = [(None, good), (None, near_good), (None, good), (None, other), (3, other), (3, third), (3, third), (None, ""), (None, None), (5, third)]
    kept = texts_of(corpus_pipeline.drop_near_copies(shipped, frame(rows), ""))
    assert [k for k in kept if k[1] in (good, near_good)] in ([("None", good)], [("None", near_good)])
    assert [k for k in kept if k[1] not in (good, near_good)] == expect([(3, other), (3, third), (None, ""), (None, "")])

    # Repeated passages: each text keeps what is its own.
    shared = line(50)
    rows = [(None, f"{shared} one {good}"), (None, f"{shared} two {other}"), (None, third), (4, f"{shared} four"), (4, bad)]
    kept = corpus_pipeline.cut_repeats(shipped, frame(rows), "")
    assert texts_of(kept) == expect([(None, f"one {good}"), (None, f"two {other}"), (None, third), (4, "four"), (4, bad)])

    # Leaks: only the row that holds the item goes.
    shipped.createDataFrame([("b", line(1) + " " + good)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, good), (None, other), (None, None), (6, f"so {good}"), (6, third)]
    kept = corpus_pipeline.drop_contaminated(shipped, frame(rows), str(tmp_path))
    assert texts_of(kept) == expect([(None, other), (None, None), (6, third)])


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are absent")
@pytest.mark.parametrize("name", ["op4_clean_lines", "op6_jaccard_join", "op9_decontamination", "op10_substring_dedup"])
def test_query_equals_sql(shipped, name):
    duckdb = pytest.importorskip("duckdb")
    from namesieve.llm.oracle import SQL
    from namesieve.llm.queries import QUERIES

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](shipped, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(repr, r)) for r in df.select(*columns).collect())
    want = Counter(tuple(map(repr, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert got == want
