import random

import pytest
from cellweave.functions.rules import COUNTS, HIGHLIFE, Rule, editor_state, int_to_rule, masks_to_rule, parse_rule, parse_rule_3d, rule_code, rule_to_int, rule_to_masks, validate_rule
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

PARSE = {2: parse_rule, 3: parse_rule_3d}
JOINT = {2: "", 3: ","}


def written(dims, birth, survival, joint=None):
    joint = JOINT[dims] if joint is None else joint
    return f"B{joint.join(map(str, birth))}/S{joint.join(map(str, survival))}"


@st.composite
def sections(draw, dims):
    counts = st.lists(st.integers(0, COUNTS[dims] - 1), unique=True, max_size=COUNTS[dims])
    return draw(counts), draw(counts)


@pytest.mark.parametrize("dims", [2, 3])
@given(data=st.data())
def test_texts_in_any_order_and_case(dims, data):
    birth, survival = data.draw(sections(dims))
    rule = PARSE[dims](data.draw(st.sampled_from([str.upper, str.lower]))(" " + written(dims, birth, survival).replace("/", " / ") + "\t"))
    assert rule.text == written(dims, sorted(birth), sorted(survival))
    assert [i for i, flag in enumerate(rule.birth) if flag] == sorted(birth) and [i for i, flag in enumerate(rule.survival) if flag] == sorted(survival)


@pytest.mark.parametrize("dims", [2, 3])
@given(data=st.data())
def test_spoilt_texts(dims, data):
    """A rule's text does not survive a repeated count, a count too many, a lost letter or slash, or a stranger."""
    birth, survival = data.draw(sections(dims))
    twice = [*birth, data.draw(st.sampled_from(birth))] if birth else [4, 4]
    beyond = [*survival, COUNTS[dims]]
    text = written(dims, birth, survival)
    spoilt = [written(dims, twice, survival), written(dims, birth, beyond), text.replace("/", ""), text[1:], text.replace("S", ""), text + "/", data.draw(st.sampled_from("xyz-.;")) + text]
    if dims == 3:
        spoilt += [written(3, [10, 11, *birth][:3], survival, "") if len({10, 11, *birth}) > 2 else "B101112/S", written(3, [1], survival) + ",", text.replace("B", "B,")]
    for each in spoilt:
        with pytest.raises(ValueError):
            PARSE[dims](each)
    for each in (None, 7, text.encode()):
        with pytest.raises(TypeError):
            PARSE[dims](each)


@pytest.mark.parametrize("dims", [2, 3])
@given(data=st.data())
def test_codes_and_masks(dims, data):
    code = data.draw(st.integers(0, (1 << 2 * COUNTS[dims]) - 1))
    rule = int_to_rule(code, dims)
    birth, survival = rule_to_masks(rule)
    assert rule_to_int(rule) == code == sum(flag << i for i, flag in enumerate(birth + survival))
    assert masks_to_rule(birth, survival, dims) == PARSE[dims](rule.text) == rule and len(birth) == COUNTS[dims]


def test_edges():
    for dims in (2, 3):
        full = (1 << 2 * COUNTS[dims]) - 1
        assert not any(int_to_rule(0, dims).birth) and all(int_to_rule(full, dims).survival)
        for code in (-1, full + 1):
            with pytest.raises(ValueError):
                int_to_rule(code, dims)
        for flags in ([1] * (COUNTS[dims] + 1), [2] * COUNTS[dims], "1" * COUNTS[dims]):
            with pytest.raises(ValueError):
                Rule(flags, [0] * COUNTS[dims], dims)
    with pytest.raises(ValueError):
        validate_rule(HIGHLIFE, 3)
    with pytest.raises(TypeError):
        validate_rule("B36/S23")


@pytest.mark.parametrize("dims", [2, 3])
def test_columns_agree(spark, dims):
    rng = random.Random(dims)
    alphabet = "0123456789,/ BbSs"
    texts = [int_to_rule(rng.getrandbits(2 * COUNTS[dims]), dims).text for _ in range(100)]
    texts += ["".join(x if rng.random() > 0.05 else rng.choice(alphabet) for x in t) for t in texts] + ["", "B/S", " b2/s "]

    def plain(text):
        try:
            return PARSE[dims](text).code
        except ValueError:
            return None

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: (r["code"], r["e"]) for r in frame.select("t", rule_code(frame["t"], dims).alias("code"), editor_state(frame["t"], dims).alias("e")).collect()}
    for t in texts:
        code, shown = got[t]
        assert code == plain(t)
        assert (shown["valid"], shown["rule"]) == ((True, int_to_rule(code, dims).text) if code is not None else (False, None))


@pytest.mark.parametrize("dims", [2, 3])
def test_a_text_is_read_once_a_row(spark, dims):
    """Each section is extracted at one place of the plan, not once for every switch that the editor shows."""
    shown = spark.range(2).select(editor_state(F.concat(F.lit("B1/S"), F.col("id").cast("string")), dims).alias("e")).select("e.valid", "e.rule", "e.birth", "e.survival")
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2
    assert [r["rule"] for r in shown.collect()] == ["B1/S0", "B1/S1"]
