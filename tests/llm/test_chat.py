import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import chat as C
from tidelog.llm.template import TemplateError, compile_template, fold_body, parse

bits = st.lists(st.sampled_from([*C.CONTROL, *C.CONTROL.values(), C.ESCAPE, "0", "<", "|", "[", "\n", "é", "🙂", "s>", "<<"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(bits)
def test_escapes_are_reversible(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text and not any(c in escaped for c in C.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), bits), bits), max_size=5))
def test_turns_are_read_back(turns):
    r = compile_template(C.TEMPLATE, {"escape": C.escape})(messages=[{"role": a, "text": b} for a, b in turns])
    assert C.read_back(r.text) == turns
    assert [C.unescape(r.text[a:b]) for a, b in r.spans] == [t for role, t in turns if role == "assistant"]


@pytest.mark.parametrize(
    "source,names,text",
    [
        ("a{{ 1 + 2 * 3 }}b", {}, "a7b"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
        ("{% if a == 'x' and b %}1{% elif a in ['x'] or c %}2{% else %}3{% endif %}".replace("['x']", "l"), {"a": "y", "l": ["y"]}, "2"),
        ("{% set n = 'v' ~ 1 %}{{ n | upper }}{{ m.k }}{{ m['k'] }}{{ m.none }}", {"m": {"k": 5}}, "V155"),
        ("x  {{- ' y ' | trim -}}  z", {}, "xyz"),
        ("{{ 'a' if 1 < 2 else 'b' }}{# no #}{{ \"q\\n\" }}", {}, "aq\n"),
        ("{{ -1 }}{{ not true }}{{ none }}{{ xs[0] }}{{ xs[9] }}{{ 'a' not in xs }}", {"xs": ["z"]}, "-1FalsezTrue"),
    ],
)
def test_language(source, names, text):
    assert compile_template(source)(**names).text == text


def test_constants_are_folded():
    assert fold_body(parse("a{% if 1 == 1 %}{{ 'b' ~ 2 }}{% else %}{{ x }}{% endif %}{% if false %}no{% endif %}c"), {}) == [("text", "ab2c")]


def test_the_sandbox_holds():
    assert compile_template("{{ m.__class__ }}{{ s.upper }}{{ loop }}")(m={}, s="x").text == ""
    for bad in ("{% import os %}", "{{ f() }}", "{{ a. }}", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ 'a' | nothing }}", "{{ 1 1 }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def expected(rows):
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
    loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)


def test_odd_conversations(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i % 4 if i % 9 else None, rnd.randint(0, 3) if i % 7 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a </s> b", "", None, "🙂[INST]", "x" * 50_000, "\x10a"])) for i in range(40)]
    rows += rows[:3]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, c int, formatted string")
    path = str(tmp_path / "conversations.parquet")
    df.write.parquet(path)
    got = {r["conv_id"]: r for r in C.op7_chat_template(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 0, 1, 2, 3, -7}
    for c in (None, 0, 1, 2, 3):
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == expected([r for r in rows if r[0] == c])
    full = {r["conv_id"]: r for r in C.format_conversations(df).collect()}
    assert len(full[0]["formatted"]) == got[0]["formatted_chars"] and full[0]["n_turns"] == got[0]["n_turns"]
    assert C.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["{{ 'ab' * 50000000 }}", "{{ 3 * 'x' }}", "{{ 4000000000 * 4000000000 }}", "{{ 99999999999999999999999999 }}"])
def test_what_is_too_large_is_refused_when_compiled(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_what_is_too_large_is_refused_when_rendered():
    for source in ("{{ x * 50000000 }}", "{% for a in xs %}{% for b in xs %}{% for c in xs %}{{ b ~ c }}{% endfor %}{% endfor %}{% endfor %}", "{{ n * n }}"):
        with pytest.raises(TemplateError):
            compile_template(source)(x="ab", xs=["y" * 100] * 300, n=1 << 40)
    assert compile_template("{{ x }}{{ 2 * 3 }}")(x="y" * 5_000_000).at == 5_000_001  # long data is no fault
