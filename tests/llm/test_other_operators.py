"""Vector dedup, packing, chat formatting, the template language and the pipeline."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terracell.llm import chat, packing, template, vector_dedup
from terracell.llm.template import Template, TemplateError

# --- 4 --------------------------------------------------------------------------------------------------------------


def brute(rows):
    ok = [(i, label, np.asarray(v, float)) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, *_ in rows}
    near = {i: {i} for i, *_ in rows}
    for a in range(len(ok)):
        for b in range(a):
            (i, li, x), (j, lj, y) = ok[a], ok[b]
            if li == lj and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                near[i].add(j)
                near[j].add(i)
    comp = {}
    for i in sorted(near):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += near[k]
    return {i: (links[i], comp[i], comp[i] == i) for i in near}


def vectors(seed, dim, count):
    g = np.random.default_rng(seed)
    rows = []
    for _ in range(count):
        base, spread = g.normal(size=dim), g.choice([0.02, 0.1, 0.2])
        for _ in range(g.integers(1, 9)):
            v = base + spread * g.normal(size=dim) * np.linalg.norm(base) / math.sqrt(dim)
            rows.append((int(g.integers(0, 3)), (v * g.choice([1.0, 3.0])).astype(np.float32).tolist()))
    rows += rows[:7] + rows[:3]  # identical vectors
    return [(i, label, v) for i, (label, v) in enumerate(rows)]


@pytest.mark.parametrize(("dim", "block"), [(64, 1024), (48, 16), (3, 1024)])
def test_vector_links_equal_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors(dim, dim, 60)
    n = len(rows)
    rows += [(n, None, rows[0][2]), (n + 1, 1, None), (n + 2, 1, [0.0] * dim), (n + 3, 1, [float("nan")] + [1.0] * (dim - 1)), (n + 4, 1, [float("inf")] * dim), (n + 5, 1, [None] + [1.0] * (dim - 1)), (n + 6, 1, [1.0] * (dim + 1)), (n + 7, 1, [2.0] * (dim + 1)), (n + 8, 1, [])]
    df = spark.createDataFrame([(i, v, label, "x") for i, label, v in rows], "vec_id bigint, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int")
    assert [tuple(r) for r in vector_dedup.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_with_null_and_repeated_ids(spark, monkeypatch, block):
    """Rows are vectors of their own, whatever their ids; rows without one link with nothing."""
    for name, value in (("BLOCK", block), ("GROWTH", 1)):
        monkeypatch.setattr(vector_dedup, name, value)
    rows = vectors(5, 16, 40)
    g = random.Random(5)
    ids = [g.choice([None, 1, 1, i, i, i]) for i in range(len(rows))]
    brute_rows = [(i, label if ids[i] is not None else None, v) for i, label, v in rows]
    links = {i: n for i, (n, _, _) in brute(brute_rows).items()}
    comp = {i: c for i, (_, c, _) in brute(brute_rows).items()}
    least = {c: min(ids[i] for i in comp if comp[i] == c and ids[i] is not None) for c in comp.values() if ids[c] is not None}
    want = sorted((ids[i] is None, ids[i] or 0, links[i], least.get(comp[i], -1), ids[i] is None or least[comp[i]] == ids[i]) for i in links)
    df = spark.createDataFrame([(ids[i], v, label) for i, label, v in rows], "vec_id bigint, embedding array<float>, label int").repartition(3)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect())
    assert got == want and sum(links.values()) > 50


def test_recall_of_the_whole_operator(spark):
    """4,000 vectors, links just above the threshold among them: links found against all cosines."""
    g = np.random.default_rng(6)
    base = g.normal(size=(1500, 64))
    near = [b + s * g.normal(size=64) for b in base for s in (0.35, 0.38) if g.random() < 0.85]
    x = np.concatenate((base, near)).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = sum(r.n_links for r in vector_dedup.near_duplicates(df).collect())
    assert close.sum() > 1000 and close.sum() >= got >= 0.999 * close.sum()


def test_buckets_grow_rather_than_lose_links():
    tables, symbols, expected = vector_dedup.plan(64, 10**9, rate=0.3)
    assert symbols < vector_dedup.plan(64, 10**9)[1] and expected <= vector_dedup.MISS
    assert vector_dedup.plan(64, 10**9, rate=0.99)[1] == 1


def test_hadamard_is_orthogonal():
    h = vector_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and set(np.round(np.abs(h).reshape(-1), 6)) == {0.25}


@pytest.mark.parametrize("largest", [100, 50_000, 10_000_000])
def test_index_misses_little(largest):
    tables, symbols, expected = vector_dedup.plan(64, largest)
    assert expected <= vector_dedup.MISS
    g = np.random.default_rng(1)
    x = g.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = g.normal(size=(1000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z
    s = vector_dedup.signs(64, tables, symbols)
    a, b = vector_dedup.codes(x, s, vector_dedup.PROBES), vector_dedup.codes(y, s, vector_dedup.PROBES)
    met = np.any([vector_dedup._meet(a[:, t], b[:, t]) for t in range(tables)], axis=0)
    assert met.mean() >= 0.997


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    e, plain = packing.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.encode == e._fast
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    rng = random.Random(12)
    bits = ["a", "ab", "don't", " ", "  ", "\n", "\t", "é", "日本", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "12", "...", "\x1c", " ", "x" * 700]
    for _ in range(600):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids(t) == np.frombuffer(e.reference(t), "<u4").tolist()


def test_added_tokens_that_ask_for_more_are_left_to_the_tokenizer():
    token = {"id": 7, "content": "<a>", "single_word": False, "lstrip": False, "rstrip": False}
    assert packing.added_ids({"added_tokens": [token]}) == {"<a>": 7} and packing.added_ids({}) == {}
    assert packing.added_ids({"added_tokens": [{**token, "lstrip": True}]}) is None
    assert packing.added_ids({"added_tokens": [token, {**token, "id": 8, "content": "<a>b"}]}) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_packing_places_every_token_once(lengths):
    packer, rows = packing.Packer(3), []
    for doc, n in enumerate(lengths):
        ids = np.arange(n, dtype="<u4").tobytes()
        for a, k in packing.cuts(n):
            rows += packer.place((doc, a, k, n, ids[4 * a : 4 * (a + k)]))
    rows += packer.close()
    seen, filled = {}, {}
    for doc, start, length, tokens, seq, offset, ids in rows:
        assert len(ids) == 4 * length and np.frombuffer(ids, "<u4")[0] == start and tokens == lengths[doc]
        seen.setdefault(doc, []).append((start, start + length))
        filled.setdefault(seq, []).append((offset, offset + length))
    for spans, total in [(seen.get(d, []), n) for d, n in enumerate(lengths)] + [(f, None) for f in filled.values()]:
        spans = sorted(spans)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and total in (None, spans[-1][1])
    sizes = [max(b for _, b in f) for f in filled.values()]
    assert all(s <= packing.CAPACITY for s in sizes)
    pad = sum(packing.CAPACITY - s for s in sizes if s & (s - 1))
    assert pad <= sum(lengths) * 0.02 + packing.CAPACITY // 33 * len(sizes) * 0.5


def test_packing_of_a_table(spark):
    from tokenizers import Tokenizer

    texts = ["hello world " * k for k in (0, 1, 5, 300, 2000)] + [None, "", "a <|endoftext|> b"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, start double").repartition(2)
    got = packing.report(df).collect()
    e = packing.Encoder()
    for i, t in enumerate(texts):
        ids = np.array([*Tokenizer.from_file(e.path).encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        assert sum(r[1] for r in mine) == len(ids) // 4 == mine[0][3]
        assert all(c == zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n, c, _ in mine)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(df.where("false")).count() == 0


# --- 10 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("{{ 1 + 2 * 3 }}|{{ 'a' ~ 1 ~ true ~ none }}|{{ 7 // 2 }}|{{ -3 + 1 }}|{{ 10 % 4 }}", "7|a1true|3|-2|2"),
        ("{% for x in v %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", "1a,2b"),
        ("{% for x in [] %}x{% else %}empty{% endfor %}", "empty"),
        ("{% if n > 3 and n < 10 %}mid{% elif n >= 10 %}big{% else %}small{% endif %}", "mid"),
        ("{% set k = 'z' %}{{ k | upper }}{{ v | join('-') }}{{ v | length }}{{ missing | default('d') }}", "Za-b2d"),
        ("a  {{- ' b ' -}}  c{# gone #}d", "a b cd"),
        ("{{ m.role }}{{ m['x'] }}{{ m.nothing }}{{ v[1] }}{{ v[-1] }}{{ v[9] }}", "r1bb"),
        ("{{ 'q' in v }}{{ 'a' in v }}{{ 'b' not in 'abc' }}{{ m is mapping }}{{ u is defined }}{{ u is not defined }}", "falsetruefalsetruefalsetrue"),
        ("{{ 'yes' if n == 5 else 'no' }}{{ 'a\\nb' | replace('\\n', '/') }}", "yesa/b"),
        ("{{ m.__class__ }}{{ v.append }}{{ m['__class__'] }}", ""),
    ],
)
def test_template_language(source, text):
    assert Template(source).render(v=["a", "b"], n=5, m={"role": "r", "x": 1})[0] == text


@pytest.mark.parametrize("source", ["{{ }}", "{% if %}", "{% if a %}", "{{ a | nope }}", "{{ f(1) }}", "{{ a", "{% endfor %}", "{{ 'a }}", "{% for 1 in x %}{% endfor %}", "{{ a is nope }}", "{{ 1 2 }}", "{{ " + "(" * 200 + "1" + ")" * 200 + " }}"])
def test_wrong_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


@pytest.mark.parametrize("source", ["{{ 'a' * 1000000 }}", "{{ 1 / 0 }}", "{{ v }}", "{% for x in 5 %}{% endfor %}", "{{ 1 < 'a' }}", "{{ 'a' | default }}{{ 'x' | replace('a') }}"])
def test_sandbox_errors_come_when_rendering(source):
    t = Template(source)
    with pytest.raises(TemplateError):
        t.render(v=[1])


def test_constants_are_folded():
    tree = template.fold(template.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{# #}d{{ 'E' | lower }}"))
    assert tree == (template.Text("ab2cde"),)
    assert template.fold(template.parse("{{ x if true else y }}")) == (template.Print(template.Name("x")),)


@given(st.text(alphabet="<|\\>im_endstar\n ok", max_size=40))
def test_escapes_are_reversible(text):
    assert template.unescape(template.escape(text)) == text and "<|" not in template.escape(text)
    line = template.escape_line(text)
    assert template.unescape_line(line) == text and "\n" not in line and "<|" not in line


@settings(max_examples=100)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\n<|role"]), st.text(alphabet="<|\\>im_end\nx", max_size=20)), max_size=6))
def test_turns_read_back(turns):
    out, spans = Template(chat.CHAT).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(out) == turns
    assert chat.learned(out, spans) == "".join(t for r, t in turns if r == "assistant")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (3, None, None, "<|im_end|>"), (0, 0, "user", "zero")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns int").repartition(3)
    got = {r.conv_id: r for r in chat.report(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {0, 1, 2, 3, None} and {k: r.n_turns for k, r in got.items()} == {0: 1, 1: 2, 2: 2, 3: 1, None: 2}
    assert got[1].turns_sha256 == sha("user\nA\nassistant\nB\n") and got[1].loss_sha256 == sha("B") and got[1].loss_chars == 1
    assert got[3].turns_sha256 == sha("\n<|im_end|>\n") and got[None].loss_sha256 == sha("m")
    assert chat.report(df.where("false")).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(13)
    en, de = ["the", "ing", "tion", "and", "ow", "er"], ["der", "ung", "sch", "ein", "keit", "los"]
    prose = lambda stems, n: " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item = prose(en, 30)
    texts = [(prose(en if i % 2 else de, rng.randint(40, 90)), "en" if i % 2 else "de") for i in range(80)]
    texts = [(t + "\nShared footer line", lang) for t, lang in texts]
    texts.append((texts[3][0], "en"))  # 80: a copy
    texts.append((texts[5][0].replace(texts[5][0].split(" ")[4], "changed", 1), "en"))  # 81: a near copy
    texts.append((prose(en, 20) + " " + item + " " + prose(en, 10), "en"))  # 82: a benchmark passage
    texts += [("12 34 !!", "en"), (None, "en"), ("", "de")]  # 83..85: no letters
    docs = spark.createDataFrame([(i, t, lang, f"s{i % 8}", len(t or "")) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    have = docs
    kept = {}
    for name, stage in p.STAGES[:-1]:
        have = stage(spark, have, str(tmp_path)).cache()
        assert have.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in have.collect()}
    assert set(kept["language ID"]) == set(range(83))
    lines = kept["line dedup"]
    assert lines[0].endswith("Shared footer line") and not any(lines[i].endswith("footer line") for i in range(1, 80))
    assert set(kept["n-gram Jaccard join"]) == set(range(83)) - {80, 81}
    assert set(kept["benchmark decontamination"]) == set(range(80))
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(80)) and p.ORACLE_SQL is None


def test_pipeline_decontaminates_by_windows(spark, tmp_path):
    import corpus_pipeline as p

    items = [(1, "one two three four five six seven eight nine"), (2, "who wrote the red book"), (3, "solo"), (4, "p q r s")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [
        "so one two three four five six seven eight then",  # a window of eight
        "one two three four five six seven",  # seven words of it
        "ask: Who wrote the red book?",  # a whole item of five words
        "who wrote the red",
        " la ".join(["solo"] * 9),  # nine hits of one word
        "p q r s",
        "nothing",
        "one two three four solo five six seven solo",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in p.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 3, 4, 6, 7]


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline_decides_by_row(spark, tmp_path):
    """Copies with one id, a unique text that shares a copy's id, a contaminated and a clean row of one id, null ids."""
    import corpus_pipeline as p

    rng = random.Random(14)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, unique, other, third = prose(40), prose(40), prose(40), prose(40)
    near = one.rsplit(" ", 1)[0] + " changed"
    rows = [(1, one), (5, one), (5, unique), (5, near), (7, other), (7, other), (7, other), (None, one), (None, one), (9, third), (8, third), (8, third + " x"), (3, ""), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCUMENTS)
    got = sorted(((r.doc_id or 0, r.text or "") for r in p.keep_one_of_each_group(spark, docs, "").collect()))
    thirds = [x for x in got if x[0] in (8, 9)]
    assert len(thirds) == 1 and thirds[0][0] == 8
    assert [x for x in got if x not in thirds] == sorted([(1, one), (5, unique), (7, other), (0, one), (0, one), (3, ""), (3, ""), (3, "")])
    spark.createDataFrame([(1, one)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = sorted((r.doc_id or 0, r.text or "") for r in p.drop_contaminated(spark, docs, str(tmp_path)).collect())
    assert kept == sorted((i or 0, t or "") for i, t in rows if t not in (one, near))


def test_pipeline_stages_leave_clashing_columns_alone(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stems = {"en": ["the", "ing", "tion", "and"], "de": ["der", "ung", "sch", "keit"]}
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(stems[g]) for _ in range(30)) + f" q{i}", g, f"s{i}", 1, 0.25) for i in range(20) for g in ["de" if i % 2 else "en"]]
    names = ["__rejected", "_score", "__removed", "removed", "k", "h", "lang_pred", "group", "doc", "text_hash"]
    docs = spark.createDataFrame([(*r, *[r[-1]] * 9) for r in rows], ", ".join([DOCUMENTS, *(f"{n} double" for n in names)]))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*names).collect()} == {(0.25,) * 10}


def test_scratch_tables_go(spark):
    import os

    from terracell.llm.shared import cut, scratch

    with scratch(spark) as keep:
        a, b = cut(spark.range(3), "gone"), keep(cut(spark.range(4), "kept"))
        gone = a.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(gone) and a.count() == 3
    assert not os.path.exists(gone) and b.count() == 4


def test_output_is_bounded_where_the_template_is_not_trusted(spark):
    loop = "{% for a in v %}{% for b in v %}{{ b }}{% endfor %}{% endfor %}"
    assert len(Template(loop, 1000).render(v=["x"] * 30)[0]) == 900 and len(Template(loop, None).render(v=["x"] * 40)[0]) == 1600
    with pytest.raises(TemplateError):
        Template(loop, 1000).render(v=["x"] * 40)
    rows = spark.createDataFrame([(1, 0, "user", "y" * 500)], "conv_id bigint, turn bigint, role string, text string")
    assert len(chat.format_conversations(rows).first().formatted) > 500
    with pytest.raises(Exception, match="too long"):
        chat.format_conversations(rows, most_chars=100).collect()
