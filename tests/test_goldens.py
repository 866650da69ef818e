"""Small goldens (inline values) for the operators."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.code import block_offsets, parses
from tessera.operators import candidates as C
from tessera.operators import explore as X
from tessera.operators import metrics as E
from tessera.operators import tokenize as T


def _bleu_ref(preds, refs, max_order=4):
    """Brute-force corpus BLEU (clipped counts, geometric mean, brevity penalty)."""
    m = [0] * max_order
    t = [0] * max_order
    hl = rl = 0
    for p, r in zip(preds, refs):
        hl += len(p)
        rl += len(r)
        for n in range(1, max_order + 1):
            hp = Counter(tuple(p[i:i + n]) for i in range(len(p) - n + 1))
            rp = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            m[n - 1] += sum(min(c, rp[g]) for g, c in hp.items())
            t[n - 1] += max(len(p) - n + 1, 0)
    prec = [m[i] / t[i] if t[i] else 0.0 for i in range(max_order)]
    if min(prec) == 0:
        return 0.0
    bp = 1.0 if hl > rl else math.exp(1 - rl / hl)
    return math.exp(sum(math.log(x) for x in prec) / max_order) * bp


BLEU_PAIRS = [("foo bar foobar barfoo", "hello there foo bar foobar barfoo"),
              ("foo bar foobar hello there", "hello there foo bar foobar hello there")]


def _pairs_df(spark, pairs):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "k long, pred string, ref string")


def test_bleu_golden_pairs(spark):
    df = _pairs_df(spark, BLEU_PAIRS)
    got = E.bleu_corpus(df, ["k"]).collect()[0]["bleu"]
    exp = _bleu_ref([p.split() for p, _ in BLEU_PAIRS], [r.split() for _, r in BLEU_PAIRS])
    assert got == pytest.approx(exp, abs=1e-12)
    mv = E.bleu_macro_vs_corpus(df, ["k"]).collect()[0]
    per = [_bleu_ref([p.split()], [r.split()]) for p, r in BLEU_PAIRS]
    assert mv["bleu_macro"] == pytest.approx(sum(per) / 2, abs=1e-12)
    assert mv["bleu_corpus"] == pytest.approx(exp, abs=1e-12)


def test_bleu_self_is_one(spark):
    df = _pairs_df(spark, [("a b c d e", "a b c d e"), ("x y z w", "x y z w")])
    assert E.bleu_corpus(df, ["k"]).collect()[0]["bleu"] == pytest.approx(1.0)
    assert E.edit_similarity(df, ["k"]).collect()[0]["edit_similarity"] == pytest.approx(1.0)
    assert E.meteor_exact(df, ["k"]).collect()[0]["meteor"] == pytest.approx(
        (1 - 0.5 * (1 / 5) ** 3 + 1 - 0.5 * (1 / 4) ** 3) / 2)
    assert E.rouge_l(df, ["k"]).collect()[0]["rouge_l"] == pytest.approx(1.0)


def test_js_golden_disjoint_one_hots(spark):
    a = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "token_id int, n long")
    b = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "token_id int, n long")
    assert X.js_distance(a, b, base=2.0).collect()[0]["js"] == pytest.approx(1.0)
    # symmetric
    ab = X.js_distance(a.union(b.limit(0)), b, base=None).collect()[0]["js"]
    ba = X.js_distance(b, a, base=None).collect()[0]["js"]
    assert ab == pytest.approx(ba)


def test_mask_fill_golden(spark):
    text = "def bubbleSort(arr): <TAB>n = len(arr) <TAB><MASK>"
    df = spark.createDataFrame([(text,)], "code string")
    out = df.select(C.fill_mask(F.col("code"), F.lit("return arr"), "<MASK>").alias("c")).collect()[0]["c"]
    assert out == "def bubbleSort(arr): <TAB>n = len(arr) <TAB>return arr"
    mid = "def bubbleSort(arr): <TAB>n = len(arr) <TAB># <MASK> <TAB># to go through the entire process"
    df = spark.createDataFrame([(mid,)], "code string")
    out = df.select(C.fill_mask(F.col("code"), F.lit("Traverse"), "<MASK>").alias("c")).collect()[0]["c"]
    assert "# Traverse <TAB>#" in out
    # the lower-case default of the reference never matches the vocabulary's mask
    out = df.select(C.fill_mask(F.col("code"), F.lit("X"), "<mask>").alias("c")).collect()[0]["c"]
    assert out == mid


def test_first_block_separators(spark):
    prompt = "def f(x):\n"
    completion = prompt + "    return x\n\ndef g():\n    pass\n"
    df = spark.createDataFrame([(prompt, completion)], "p string, c string")
    out = df.select(C.first_block(F.col("p"), F.col("c")).alias("b")).collect()[0]["b"]
    assert out == "def f(x):\n    return x"
    for sep in ("class", "#", "@", "print", "if"):
        c = prompt + "    y = 1\n" + sep + " z"
        d = spark.createDataFrame([(prompt, c)], "p string, c string")
        assert d.select(C.first_block(F.col("p"), F.col("c")).alias("b")).collect()[0]["b"] == prompt + "    y = 1"


def test_specials_and_vocab_size(spark):
    docs = spark.createDataFrame([("a b c a b a",), ("d e",)], "text string")
    v = T.with_added_tokens(T.word_vocab(docs, "text", vocab_size=4))
    rows = {r["token"]: (r["token_id"], r["special"]) for r in v.collect()}
    T.vocab_size_check(v, 4)
    assert [rows[t][1] for t in T.SPECIAL_TOKENS] == [True] * 4
    assert rows["<NEW_LINE>"][1] is False
    assert rows["<UNK>"][0] == 0 and rows["a"][0] == 1 and rows["b"][0] == 2
    assert [rows[t][0] for t in T.SPECIAL_TOKENS + T.ADDED_TOKENS] == [4, 5, 6, 7, 8]


def test_byte_alphabet(spark):
    rows = T.byte_alphabet(spark).collect()
    assert len(rows) == 256
    same = [r for r in rows if r["byte"] == r["code_point"]]
    assert len(same) == 188
    by = {r["byte"]: r["symbol"] for r in rows}
    assert by[32] == "Ġ" and by[ord("a")] == "a" and by[0] == "Ā"
    assert len({r["symbol"] for r in rows}) == 256


def test_block_offsets_and_parse():
    src = "def bubbleSort(arr):\n    n = len(arr)\n    for i in range(n):\n        x = i\n    return arr\n"
    blocks = [src[a:b] for a, b in block_offsets(src)]
    assert blocks[0].startswith("n = len(arr)") and blocks[0].endswith("return arr")
    assert blocks[1] == "x = i"
    assert parses(src)
    assert not parses("def f(:")
    assert not parses("x = 1\x00")
    assert block_offsets("not python at all (") == []


def test_pass_at_k_monotone_and_known(spark):
    rows = [("t1", i, 1 if i < 3 else 0) for i in range(10)] + [("t2", i, 0) for i in range(10)]
    df = spark.createDataFrame(rows, "task string, cand int, ok int")
    got = {r["k"]: r["pass_at_k"] for r in C.pass_at_k(df, "task", "ok", (1, 2, 5, 10, 20)).collect()}
    assert 20 not in got  # a k is reported only when every task has n >= k
    # t1: n=10, c=3 -> pass@1 = 0.3 ; t2: 0
    assert got[1] == pytest.approx(0.15)
    ks = sorted(got)
    assert all(got[a] <= got[b] + 1e-12 for a, b in zip(ks, ks[1:]))
    assert got[10] == pytest.approx(0.5)


def test_token_alphabet_beyond_surrogates(spark):
    """Alphabet positions past the space below the surrogate block still map
    to distinct, valid BMP characters."""
    from tessera.functions.text import code_point_char, token_code_point
    df = spark.range(1, 63233).select(code_point_char(token_code_point(F.col("id"))).alias("c"))
    chars = [r["c"] for r in df.collect()]
    assert all(len(c) == 1 for c in chars) and len(set(chars)) == len(chars)
    assert all(not (0xD800 <= ord(c) <= 0xDFFF) for c in chars)


# ------------------------------------------------- nested blocks and brackets

CODE = '''class A:
\t"""doc
  string: (
\t"""
\t@deco
\tdef f(self, a: int = 3) -> int: return a[1:2]

\tdef g(self):
\t\tif x := f(): pass
\t\telif y \\
\t\t  and z:
# a comment at the margin
\t\t\tb = {"k": [1,
2]}
\t\telse:
\t\t\ttry:
\t\t\t\ta = lambda: 3
\t\t\texcept E as e:
\t\t\t\traise
\t\t\tfinally:
\t\t\t\tb = "#not : comment"  # comment :

\t\treturn "é"
z = {1: 2}
'''


def _blocks(spark, code):
    from tessera.operators.masking import code_blocks
    df = spark.createDataFrame([(1, code)], "doc_id int, code string")
    return [code[r["start"]:r["start"] + r["span_len"]] for r in code_blocks(df).orderBy("block_no").collect()]


def test_nested_blocks_in_pre_order(spark):
    got = _blocks(spark, CODE)
    assert [b.split("\n")[0] for b in got] == [
        '"""doc', "return a[1:2]", "if x := f(): pass", "pass", 'b = {"k": [1,', "try:", "a = lambda: 3", "raise",
        'b = "#not : comment"']
    assert got[0].endswith('return "é"') and got[2].endswith('return "é"') and got[4].endswith("2]}") and got[5].endswith('comment"')


def test_nested_blocks_equal_the_syntax_tree(spark):
    from tessera.functions.code import block_offsets
    for code in ("def f(a):\n    n = 1\n    for i in n:\n        x = i\n\n        y = [\n1]\n    return a\n", "x = 1\n", "",
                 "if é:\n    ö = \"'\"\n    ß = 1", "while (1,\n 2):\n  with a as b, c as d:\n    pass\n", "  \n\n"):
        exact = [code[a:b] for a, b in sorted(block_offsets(code), key=lambda x: (x[0], -x[1]))]
        assert _blocks(spark, code) == exact


def test_block_tasks_restore_the_program(spark):
    from tessera.operators.masking import MASK_TOKEN, block_tasks
    df = spark.createDataFrame([(1, CODE), (2, None), (3, "")], "doc_id int, code string")
    rows = block_tasks(df).collect()
    assert len(rows) == 9
    assert all(r["masked_prompt"].replace(MASK_TOKEN, r["solution"]) == CODE for r in rows)


def test_brackets_reduce_in_order(spark):
    cases = {"": True, "()": True, ")(": False, "([)]": False, "{[()]}()": True, "(": False, "]": False, "'('": True, '"': False, "it's": False,
             "# it's (\n[]": True, 'f("""(""")': True, "'\\')' + ')'": True, "(" * 500 + ")" * 500: True, "(" * 500 + ")" * 499: False}
    df = spark.createDataFrame([(c,) for c in cases], "candidate string")
    kept = {r["candidate"] for r in C.nested_candidates(df).collect()}
    assert kept == {c for c, ok in cases.items() if ok}
    valid = spark.createDataFrame([("x = (1)",), ("x = )1(",), ("x = = 1",)], "candidate string")
    assert [r["candidate"] for r in C.valid_candidates(valid).collect()] == ["x = (1)"]
