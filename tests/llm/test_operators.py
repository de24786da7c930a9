"""The training-data operators against brute force, on texts with nulls, empties, copies, ties and clashing columns."""

import random
import re
import zlib

import pytest

from lodestone.llm import chat_format, decontaminate, html_extract, ngram_join, packing, quality_rules, sharding, suffix_dedup, token_counts, toxicity

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage, out = say(300), say(60), [None, "", " \n\t ", "one", "A b c", "x" * 700, "ab " * 400]
    for _ in range(40):
        words = base.split()
        for k in rnd.sample(range(300), rnd.randint(0, 14)):
            words[k] = rnd.choice(vocabulary)
        out.append(" ".join(words))
    out += [base, base, base.upper()] + [say(rnd.randint(1, 200)) + " " + passage + "\n" + say(rnd.randint(0, 100)) for _ in range(30)]
    out += [say(rnd.randint(1, 12)) for _ in range(80)] + [say(9000)]
    return list(enumerate(out))


DOCS = corpus()
CLASHES = "node _covers _COVERS_ asks _asks _ask_id ask_id _cover_id _of _kept _bad _row row key _row_key _doc_id grp h1 h2 rep n doc at bucket payload a b label comp bits _id toxic held_out a.b".split()


@pytest.fixture(scope="module")
def docs(spark):
    # with columns that clash with names inside the operators
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t), *[f"z{i}"] * len(CLASHES)) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_suffix_dedup(docs, empty):
    got = {r.doc_id: r for r in suffix_dedup.removed_spans(docs).collect()}
    seen = set()
    for i, t in DOCS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        assert got[i].n_bytes == len(b)
        assert sum(s.last - s.first for s in got[i].spans) == sum(gone), i
        assert bytes(got[i].kept) == bytes(c for c, z in zip(b, gone) if not z)
    assert suffix_dedup.removed_spans(empty).count() == 0


def test_suffix_dedup_of_segments(spark, monkeypatch):
    """A text that is looked at in many segments, with repeats across their ends."""
    rnd = random.Random(11)
    say = lambda n: "".join(rnd.choice("abcdefgh ß") for _ in range(n))
    part = say(1500)
    texts = [say(700) + part + say(900) + part[300:] + say(400) + part[:350] + say(2000), part[100:900]]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 250)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.removed_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        assert got[i] == bytes(c for c, z in zip(b, gone) if not z)


def test_equal_hashes_of_unlike_suffixes(monkeypatch):
    """Windows that a hash confuses are told apart by their bytes."""
    import numpy as np

    x = np.zeros(4, suffix_dedup.SUFFIX_TYPE)
    x["d"], x["p"], x["left"], x["right"] = [1, 2, 3, 4], 40, suffix_dedup.NEAR, 0
    x["text"][:, : suffix_dedup.NEAR] = np.array([7, 8, 7, 8])[:, None]
    want = suffix_dedup.equal_suffixes(x)
    assert want["d"].tolist() == [3, 4]
    monkeypatch.setattr(suffix_dedup, "byte_table", lambda _: np.ones(256, np.uint64))
    assert (suffix_dedup.equal_suffixes(x) == want).all()


def test_dedup_text_keeps_characters(docs):
    found = suffix_dedup.dedup_text(docs)
    assert found.columns == docs.columns
    for r in found.collect():
        assert {r[c] for c in CLASHES} == {f"z{r.doc_id}"}
        assert (r.text is None and r.n_chars is None) or len(r.text) == r.n_chars


def test_suffix_dedup_of_null_and_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(2**60 + 1, a), (2**60 + 2, "x " + a), (None, "y " + a), (None, b), (None, b), (None, None), (3, c + " one"), (3, "two, but longer, " + d), (4, d), (5, "p " + c), (4, d)]
    found = suffix_dedup.dedup_text(spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(2))
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    assert got == sorted([(2**60 + 1, a), (2**60 + 2, "x "), (None, "y"), (None, b), (None, ""), (None, None), (3, c + " one"), (3, "two, but longer, " + d), (4, ""), (5, "p "), (4, "")], key=repr)


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [80, 60])
def test_ngram_join(docs, empty, percent):
    sets = {i: shingles(t) for i, t in DOCS}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    for r in ngram_join.near_duplicates(docs, percent=percent).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), top(r.doc_id))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_small_sets_share_signatures():
    """Signatures meet for all pairs of small sets that are similar."""
    import numpy as np

    rnd, starts = random.Random(3), ngram_join.band_starts(80)
    for _ in range(4000):
        n = rnd.randint(2, 30)
        x = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        y = np.unique(np.concatenate([x[rnd.randint(0, max(n // 9, 0)) :], np.array([rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 8))], np.uint64)]))
        c = len(np.intersect1d(x, y))
        if 100 * c >= 80 * (len(x) + len(y) - c) and c < len(x) + len(y) - c:
            assert len(np.intersect1d(ngram_join.signatures(x, 80, starts), ngram_join.signatures(y, 80, starts))), (x, y)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_polynomials_confuse(spark):
    """Two words of 2,048 letters whose difference is a polynomial that vanishes modulo 2**64 at every odd number."""
    import numpy as np

    from lodestone.llm.common import word_hashes

    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    data = np.frombuffer((x + y + x[:60] + y[:60] + "abc").encode(), np.uint8)
    at = np.cumsum([0, 2048, 2048, 60, 60, 1, 2])
    assert len(set(word_hashes(data, at[:-1], at[1:]).tolist())) == 6
    docs = spark.createDataFrame([(1, f"{x} one two three four five"), (2, f"{y} one two three four five"), (3, x), (4, y)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {k: k for k in (1, 2, 3, 4)}
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(0, x)], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 1, 2: 0, 3: 1, 4: 0}
    test_token_counts(docs, [tuple(r) for r in docs.collect()])
    test_packing(docs, docs.limit(0), [tuple(r) for r in docs.collect()])


def test_unlike_sets_of_one_large_group_are_not_all_compared(spark):
    """5,000 sets that share a passage of 60 shingles, and so many signatures, but are similar in eight pairs only."""
    import numpy as np

    rnd = np.random.default_rng(3)
    passage = rnd.integers(0, 2**62, 60)
    own = [np.sort(np.concatenate([passage, rnd.integers(0, 2**62, 60)])) for _ in range(5000)]
    for k in range(8):
        own[2 * k + 1] = np.sort(np.concatenate([own[2 * k][:-5], rnd.integers(0, 2**62, 5)]))
    own = [x.astype(np.uint64) for x in own]
    bits = ngram_join.bitmaps(own)
    sets = spark.createDataFrame([(k, x.tolist(), b.tolist()) for k, (x, b) in enumerate(zip(own, ngram_join.bitmaps(own, ngram_join.WIDE)))], "node long, shingles array<long>, wide array<long>")
    kind = "struct<" + ",".join(f"b{k}:long" for k in range(ngram_join.BITS)) + ">"
    groups = spark.createDataFrame([(1, k, len(x), tuple(b.tolist())) for k, (x, b) in enumerate(zip(own, bits))], f"grp long, node long, n long, bits {kind}")
    labels = ngram_join.link_nodes(groups, sets, 80)
    assert sorted(tuple(r) for r in labels.collect()) == sorted((2 * k + j, 2 * k) for k in range(8) for j in range(2))
    met = ngram_join._groups(ngram_join._dealt_cheapest(sets, 80, 4).repartition(4, "bucket")).groupBy("grp").count()
    compared = met.selectExpr("sum(count * (count - 1) / 2) as n").first().n
    assert compared < 5000  # of 12.5 million


#: Null doc_ids (copies, near copies, a chain that only a null links, unique ones, no words), two texts of one doc_id, repeated rows, ids above 2 ** 53.
BIG = 2**60 + 1
_T = " ".join(f"w{k}" for k in range(100))
_S = " ".join(f"s{k}" for k in range(100))
SHARED = [
    (BIG, _T), (None, _T + " w100 w101 w102 w103 w104 w105 w106 w107 w108 w109 w110 w111"), (BIG + 1, _T + " " + " ".join(f"w{k}" for k in range(100, 124))),
    (None, "n1 " + _S), (None, _S), (None, _S), (None, _S.upper()), (None, None), (None, ""), (None, ""), (None, "quite unique words of nobody else here"),
    (5, "the first text of number five"), (5, "another unlike text that has number five"), (5, "the first text of number five"), (6, ""), (6, ""), (6, None), (7, "the first text of number five"), (8, "alone")
]


@pytest.fixture(scope="module")
def shared(spark):
    return spark.createDataFrame([(i, t, None if t is None else len(t), "z") for i, t in SHARED], "doc_id long, text string, n_chars long, node string").repartition(3)


def linked(rows, percent=80):
    """Brute force: the least row, by doc_id with nulls last, of each row's component."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((top(a), top(b)), key=lambda x: (rows[x][0] is None, rows[x][0] or 0, x))
                up[y] = x
    return [top(x) for x in range(len(rows))]


def ordered(rows):
    return sorted(rows, key=repr)


def test_ngram_join_of_null_and_shared_ids(shared):
    top = linked(SHARED)
    got = [tuple(r) for r in ngram_join.near_duplicates(shared).collect()]
    assert ordered(got) == ordered([(i, len(shingles(t)), SHARED[top[k]][0]) for k, (i, t) in enumerate(SHARED)])
    assert BIG in [c for i, _, c in got if i == BIG + 1]  # through the null between them


def test_keep_one_of_null_and_shared_ids(docs, shared):
    top = linked(SHARED)
    out = ngram_join.keep_one(shared)
    assert out.columns == shared.columns
    found = [(r.doc_id, shingles(r.text)) for r in out.collect()]
    want = [SHARED[k] for k in range(len(SHARED)) if top[k] == k and (SHARED[k][0] is None or SHARED[k] not in SHARED[:k])]
    near = lambda i, s: (i, sorted(s) if len(s) < 50 else len(s) // 10)  # noqa: E731  which of a null's near copies stays is open
    assert ordered([near(i, s) for i, s in found]) == ordered([near(i, shingles(t)) for i, t in want])
    top = linked(DOCS)
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [k for k in range(len(DOCS)) if top[k] == k]


def test_packing_of_null_ids(shared):
    rows = packing.pack_documents(shared, packing.tokenizer_file()).collect()
    assert ordered([r.doc_id for r in rows]) == ordered([i for i, _ in SHARED])


@pytest.mark.parametrize("block", [decontaminate.PHRASE_BYTES, 200])
def test_decontaminate(spark, docs, empty, block):
    rnd = random.Random(1)
    items = [(0, None), (1, ""), (2, "one"), (3, "A B"), (4, DOCS[50][1][100:400]), (5, "nothing like this is there " * 3), (6, DOCS[60][1]), (7, DOCS[60][1][30:300])] + [(8 + k, " ".join(rnd.sample("a b c d e f g h".split(), 3))) for k in range(5)]
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, phrase_bytes=block).collect()}
    for i, t in DOCS:
        w, hit, found = words(t), set(), set()
        for item, p in items:
            v = words(p)
            for s in range(max(len(v) - 12, min(len(v), 1))):
                x = v[s : s + 13]
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit.update(range(k, k + len(x)))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)), i
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [decontaminate.PHRASE_BYTES, 60])
def test_decontaminate_judges_each_row(spark, block):
    one, two = "one two three four five six seven", "red green blue black white grey pink"
    rows = [(1, one), (1, one), (1, "other words " * 3), (None, one), (None, two), (None, "a b c d e f g"), (None, None), (2, two + " x " + one), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(0, one), (1, two), (2, "nothing of this sort is anywhere in there")], "item_id long, text string")
    items = lambda t: [str(k) for k, x in enumerate((one, two)) if x in (t or "")]
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.find_contamination(docs, bench, phrase_bytes=block).collect()]
    assert ordered(got) == ordered([(i, len((t or "").split()), 7 * len(items(t)), items(t), bool(items(t))) for i, t in rows])
    assert ordered([tuple(r) for r in decontaminate.drop_contaminated(docs, bench).collect()]) == ordered([(i, t) for i, t in rows if not items(t)])


def test_packing(docs, empty, rows_in=DOCS):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(packing.tokenizer_file())
    rows = packing.pack_documents(docs, packing.tokenizer_file()).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    n = 0
    for i, text in rows_in:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], np.uint32)
        for k in range(0, len(ids), 4096):
            r, own, n = got[(i, k // 4096)], ids[k : k + 4096], n + 1
            assert (r.start, r.length, r.ids_crc32) == (k, len(own), zlib.crc32(own.tobytes()))
    assert n == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty, packing.tokenizer_file()).count() == 0


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (6, 8, 7, 4, 2)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 7)]


def test_token_counts(docs, rows_in=DOCS[:90]):
    pieces = set(token_counts.vocabulary_pieces(packing.tokenizer_file()))
    longest = max(map(len, pieces))

    def greedy(w):
        n = at = 0
        while at < len(w):
            at += next(k for k in range(min(longest, len(w) - at), 0, -1) if w[at : at + k] in pieces)
            n += 1
        return n

    got = {r.doc_id: r for r in token_counts.count_tokens(docs, packing.tokenizer_file()).collect()}
    for i, t in rows_in:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW))
        assert (got[i].n_words, got[i].n_tokens) == (len(w), sum(map(greedy, w)))


def test_quality_rules(docs, empty):
    for r in quality_rules.judge(docs).collect():
        t = DOCS[r.doc_id][1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {x for x in tri if tri.count(x) > 1} if len(tri) < 1000 else None
        if twice is not None:
            assert r.n_repeat_words == len({k + j for k, x in enumerate(tri) if x in twice for j in range(3)})
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "system", "be <|end|> & kind"), (1, 1, "user", None), (1, 2, "assistant", "&lt;<|turn|>"), (1, 2, "assistant", "&lt;<|turn|>"), (2, 0, None, ""), (3, 5, "assistant", "w " * 3000), (None, 0, "user", "x")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"t{k} " * 100) for k in range(60)] + [(4, -1, "system", "sys")]
    c = chat_format.with_extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    windows = chat_format.format_windows(c)
    back = chat_format.read_back(windows).collect()
    rows += [(-7, 0, "user", chat_format.EXTRA), (-7, 1, "assistant", chat_format.EXTRA)]
    for conv in {r[0] for r in rows}:
        own = sorted((t, r or "", x or "") for i, t, r, x in rows if i == conv)
        parts = sorted((b for b in back if b.conv_id == conv), key=lambda b: b.win)
        assert [(t.role, t.text) for b in parts for t in b.turns] == [(r, x) for _, r, x in own]
        assert "".join(b.loss_text for b in parts) == "".join(x for _, r, x in own if r == "assistant")
    later = [w.formatted for w in windows.filter("conv_id = 4").orderBy("win").collect()][1:]
    assert later and all("<|again|>system<|text|>sys<|end|>" in w for w in later)


def test_chat_windows_keep_their_budget(spark):
    """No window holds more than the budget, but one of a single turn that does not fit beside the system turn."""
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice(["a", "be", "<x>", "&", "no."]) for _ in range(n))
    rows = []
    for conv, (system, most) in enumerate([(0, 300), (20, 300), (200, 150), (400, 400), (500, 1500), (2000, 700), (3, 5)]):
        rows += [(conv, 0, "system", say(system), "z")] * (system > 0)
        rows += [(conv, k, ("assistant", "user")[k % 2], say(rnd.randint(0, most)), "z") for k in range(1, 40)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    shown = [(w.conv_id, w.win, re.findall(r"<\|(turn|again)\|>(.*?)<\|text\|>(.*?)<\|end\|>", w.formatted, re.S)) for w in chat_format.format_windows(c).collect()]
    n = lambda role, text: len(re.findall(r"[^\W_]+|[^\w\s]|_", f"{role} {text}")) + 3
    full = 0
    for conv, _, parts in shown:
        new = [p for p in parts if p[0] == "turn"]
        again = [p for p in parts if p[0] == "again"]
        size = sum(n(*p[1:]) for p in parts)
        full += len(new) > 1
        if size > chat_format.BUDGET:
            assert len(new) == 1 and all(p[1] == "system" for p in again), (conv, size)
        assert len([p for p in again if p[1] != "system"]) <= chat_format.HISTORY_TURNS
    assert full > 20
    assert chat_format.format_windows(c.limit(0)).count() == 0
    # windows of a conversation with a short system turn all show it; one too long is never repeated
    assert all(any(p[1] == "system" for p in parts) for conv, _, parts in shown if conv in (1, 2, 6))
    assert sum(p[1] == "system" for conv, _, parts in shown if conv == 5 for p in parts) == 1


def test_sharding(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", per_arrival=10, target_bytes=20_000)
    store.append(docs.filter("doc_id < 70"))
    store.append(docs.filter("doc_id >= 70"))
    assert store.compact()["version"] == 3
    with pytest.raises(RuntimeError):
        store.manifest.commit({}, 2)
    got = store.read().select("doc.*", "shard").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t in DOCS)
    assert len({r.shard for r in got}) > 3
    assert store.compact()["version"] == 3  # nothing is left to merge


def test_sharding_over_many_appends(spark, shared, empty, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", per_arrival=1, target_bytes=300)
    assert store.read().count() == 0
    want = []
    content = lambda: ordered(tuple(r) for r in store.read().select("doc.doc_id", "doc.text").collect())
    for k in range(3):
        store.append(shared)
        want += [(i, t) for i, t in SHARED]
        before = {r.seq: r.folder for r in store.runs(store.manifest.latest()).collect()}
        if k:
            store.compact()
            runs = store.runs(store.manifest.latest()).collect()
            kept = [r for r in runs if before.get(r.seq) == r.folder]
            assert kept and len(runs) < len(before)  # some runs stay as they are
            assert all(sum((r.seq // sharding.CHUNK, r.tier) == (x.seq // sharding.CHUNK, x.tier) for x in runs) < sharding.FANOUT for r in runs)
        assert content() == ordered(want)
    version = store.manifest.latest()["version"]
    with monkeypatch.context() as m:  # a writer is lost between data and manifest, another within the manifest
        m.setattr(store.manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.append(shared)
    (tmp_path / "s" / f"manifest-{version + 1}.json").write_text('{"version": ')
    assert content() == ordered(want) and store.manifest.latest()["version"] == version
    assert store.append(shared)["version"] == version + 2
    assert content() == ordered(want + SHARED)
    assert store.append(shared.limit(0))["version"] == version + 3 and content() == ordered(want + SHARED)
    none = sharding.ShardStore(spark, f"file://{tmp_path}/none")
    none.append(empty)
    none.compact()
    assert none.read().count() == 0 and none.read().select("doc.*").columns == empty.columns


def test_html():
    tree = html_extract.Tree(list(html_extract.TRAINING))
    page = "<head><title>t</title></head><body><header>Site</header><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p><b>One<br>two<p>x</p><aside>side</aside><script>var a='</p>'</script><p>1 &lt; 2</article><section id='comments'><p>Nice one, a long comment about it</p></section><form>Your name</form><footer>&copy;</footer>"
    assert html_extract.main_text(page, tree) == "A & B\nOne two\nx\n1 < 2"
    assert html_extract.main_text(None, tree) == html_extract.main_text("", tree) == ""


PARAGRAPH = "A paragraph of an article, which has many words in it and goes on for a while."


@pytest.mark.parametrize(
    "page",
    [
        "<main class='layout with-sidebar'><p>{}</p></main>", "<article class='post has-comments'><p>{}</p></article>", "<div class=no-sidebar><p>{}</p></div>", "<form id=aspnetForm><article><p>{}</p></article></form>",
        "<form id=aspnetForm><p>{}</p></form>", "<svg/><p>{}</p>", "<iframe/><p>{}</p>", "<button><p>{}</p>", "<p>{}</p><script>x", "<!-- <p>no</p> --><p title='a>b'>{}</p><!-- <p>no</p>", "<nav><a href=/>Home</a></nav></x></div><p>{}</p>",
        "<article><p>{}</p></article><section id=comments><article><p>{}</p></article></section>", "<article><p>{}</p></article><article class=comment><p>{}</p></article>", "<aside><article><p>{}</p></article></aside><p>{}</p>",
    ],
)
def test_html_of_odd_markup(page):
    tree = html_extract.Tree(list(html_extract.TRAINING))
    assert html_extract.main_text(page.replace("{}", PARAGRAPH), tree) == PARAGRAPH


def test_html_is_read_in_linear_time():
    import time

    tree, began = html_extract.Tree(list(html_extract.TRAINING)), time.time()
    for page in ("<a " * 300_000, '<a "' * 200_001 + ">", "<div>" * 100_000 + "</x>" * 100_000, "<p a='" * 100_000, "<script>" * 50_000, "<!--" * 200_000, "<button>" * 50_000):
        html_extract.main_text(page, tree)
    assert time.time() - began < 30


def test_html_table(spark):
    rows = [(1, "u", f"<p>{PARAGRAPH}</p>", 5), (1, "u", f"<p>{PARAGRAPH}</p>", 5), (2, None, None, None), (None, "v", "", 1), (2**60 + 1, "w", "<article><p>x &eacute;&#33;<br>y\n z</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = ordered([tuple(r) for r in html_extract.extract(pages).collect()])
    assert got == ordered([(1, "u", PARAGRAPH, len(PARAGRAPH))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (2**60 + 1, "w", "x é! y z", 8)])
    assert html_extract.extract(pages.limit(0)).count() == 0


def independent(page):
    """Main text by Python's own parser: what is in article or main, or else outside of furniture."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks, self.now = [], [], ""

        def close_block(self):
            if words := self.now.split():
                self.blocks.append((" ".join(words), any(n in ("article", "main") for n, _ in self.stack), any(f for _, f in self.stack)))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in html_extract.INLINE:
                self.now += " " if tag == "br" else ""
                return
            self.close_block()
            if tag not in ("meta", "link", "hr", "input", "base", "col", "area", "embed", "source", "track", "param"):
                names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
                self.stack.append((tag, tag in html_extract.FURNITURE | html_extract.HIDDEN or bool(html_extract.NAMED.search(names))))

        def handle_endtag(self, tag):
            if tag in html_extract.INLINE:
                return
            self.close_block()
            if tag in [n for n, _ in self.stack]:
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            self.now += data

    reader = Reader()
    reader.feed(page or "")
    reader.close_block()
    own = [b for b in reader.blocks if not b[2]]
    return "\n".join(t for t, content, _ in own if content or not any(c for _, c, _ in own))


def test_html_of_all_pages_against_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows)).collect()}
    assert [r.page_id for r in rows if got[r.page_id] != independent(r.html)] == []


def test_toxicity(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(k, " ".join([word() for _ in range(30)] + (["Zonker", "zonkest", "brag"] if k % 5 == 0 else [])) + ".", int(k % 5 == 0)) for k in range(600)] + [(600, None, 0), (601, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.predicted == rows[r.doc_id][2] and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = toxicity.drop_toxic(docs, docs)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, _, y in rows if not y]


@pytest.mark.parametrize(
    "text, pattern",
    [
        ('a 5" pipe. zonker', "insult"),
        ('he: "well zonker. fine', "insult_reported"),
        ('he: "well. fine zonker', "insult"),
        ('he: "well. fine, zonker" ok', "insult_reported"),
        ('he: "well. fine" zonker', "insult"),
        ('"well. fine. "good" zonker', "insult"),
        ("er: „na. zonker“ gut", "insult_reported"),
        ("er: „na ja“ zonker. zack", "insult"),
        ("er: »na. zonker« gut", "insult_reported"),
        ("lui: « bon. zonker » bien", "insult_reported"),
        ("lui: « bon » zonker", "insult"),
        ("“a „b“ zonker” c", "insult_reported"),
        ('He left 5" of snow. You zonker!', "insult_targeted"),
        ("ok you. zonker now", "insult"),
        ("zonker. you there", "insult"),
        ("zonker, that is you", "insult_targeted"),
        ("not a, b zonker", "insult_negated"),
        ("not a b c zonker", "insult"),
        ("he said a b c d zonker", "insult_reported"),
        ("he said so. zonker", "insult"),
        ("zonker zonker and zonker", "insult"),
        ("kill", "threat"),
        ("we kill you", "threat_targeted"),
        ("never kill", "threat_negated"),
        ('"we kill you"', "threat_reported"),
    ],
)
def test_quotations(text, pattern):
    found = toxicity.Grammar({"zonker": 1.0}, {}, [1.0] * 8, 0.0).matches(text)
    assert dict(zip(toxicity.PATTERNS, found)) == {p: float(p == pattern) for p in toxicity.PATTERNS}


def test_composition_is_one_machine_after_another():
    rnd = random.Random(2)
    report, target = toxicity.reporting(toxicity.NEGATION.outputs()), toxicity.within(toxicity.REPORTED.outputs(), "t", ">")
    for _ in range(300):
        x = rnd.choices(toxicity.ALPHABET, k=rnd.randint(0, 12))
        assert list(toxicity.FORWARD(x)) == list(target(report(toxicity.NEGATION(x))))


def test_toxicity_of_null_and_large_ids(spark, empty):
    ids = [2**60 + 1, None, 2**60 + 3, None]
    docs = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").coalesce(1)
    grammar = toxicity.Grammar({}, {}, [1.0] * 8, -2.0)
    assert [r.doc_id for r in toxicity.score_documents(docs, grammar).collect()] == ids
    assert toxicity.score_documents(empty, grammar).count() == toxicity.drop_toxic(empty, docs.selectExpr("doc_id", "1 as toxic")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            assert before is None or docs.count() <= before
            before = docs.count()
        else:
            assert out.select("doc_id").distinct().count() == before


def without_repeats(rows):
    """Brute force: texts without the characters that lie in windows of 100 bytes which came before."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        at, text = 0, ""
        for c in t or "":
            n = len(c.encode())
            text += "" if all(gone[at : at + n]) else c
            at += n
        out.append((i, None if t is None else text))
    return out


def uncontaminated(rows, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))
    phrases = {tuple(v[s : s + 13]) for v in map(words, items) for s in range(max(len(v) - 12, min(len(v), 1)))}
    out = []
    for i, t in rows:
        w = words(t)
        hit = {k + j for k in range(len(w)) for n in {*map(len, phrases)} if tuple(w[k : k + n]) in phrases for j in range(n)}
        out += [] if hit and 20 * len(hit) >= len(w) else [(i, t)]
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(5)
    toxic = [(1000 + k, " ".join("".join(rnd.choice("fghijk") for _ in range(6)) for _ in range(30)) + " zonker zonkest") for k in range(40)]
    rows, items = DOCS + toxic, [DOCS[60][1][100:400], DOCS[100][1]]
    frame = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    frame([(i, 1, int(i >= 1000)) for i, _ in rows], "doc_id long, quality int, toxic int", "labels")
    frame(list(enumerate(items)), "item_id long, text string", "benchmark")
    top = linked(DOCS)
    single = [DOCS[k] for k in range(len(DOCS)) if top[k] == k]
    want = [DOCS, single, without_repeats(single)]
    want.append(uncontaminated(want[-1], items))
    assert want[2] != want[1] and len(want[3]) < len(want[2]) < len(DOCS)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == want[k], name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in packed.filter("piece = 0").collect()) == [i for i, _ in want[3]]
