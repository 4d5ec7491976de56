import math
import random
import re

import numpy as np

from wrackline.llm import secrets as se

from .conftest import corpus

SAMPLES = [
    "password=abc password: 'abcdefgh1' SECRET = \"x.y/z+12=\" api_key:12345678 apikey=short Token==--------",
    "token=secret:abcdefghij then passwd = aaaaaaaa",
    "AKIA1234 AKIAABCDEFGHIJKL AKIAAKIA1234567890 xAKIAABCDEFGHIJK9z",
    "d41d8cd98f00b204e9800998ecf8427e D41D8CD98F00B204E9800998ECF8427E " + "a" * 32 + "g" + "b" * 31,
    "ſecret=abcdefgh1 toKen=abcdefgh1 ünder password=12345678",
]


def slow(text):
    """The patterns as they stand, failing matches dropped afterwards."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_base_spans():
    for text in SAMPLES + [t or "" for _, t in corpus()]:
        assert se._joined(se.base_spans(text)) == slow(text)


def test_chi2_tail():
    assert abs(se.chi2_tail(14.067, 7) - 0.05) < 1e-4 and abs(se.chi2_tail(5.991, 2) - 0.05) < 1e-4 and se.chi2_tail(0, 7) == 1


def test_random_tokens_pass_and_structured_ones_fail():
    r = random.Random(2)
    alphabet = dict(se.ENCODINGS)["base64"]
    p = [se.battery("".join(r.choices(alphabet, k=40)), alphabet) for _ in range(400)]
    assert np.mean(np.array(p) <= 0.05) < 0.12
    assert se.battery("a1" * 20, dict(se.ENCODINGS)["base36"]) < 1e-4
    assert se.battery("0123456789" * 4, se.DIGITS) < 1e-3


def test_binomial_tail():
    assert abs(se.upper_tail(3, 5, 0.5) - 0.5) < 1e-12 and se.upper_tail(0, 9, 0.1) == 1 and abs(se.upper_tail(2, 2, 0.3) - 0.09) < 1e-12


def slow_step_up(places, rate):
    """The step-up on the p-values themselves: the largest k such that the k-th is at most rate * k / m."""
    p = sorted((math.exp(-q / se.GRID), q) for q in places)
    held = [q for k, (x, q) in enumerate(p, 1) if x * len(p) <= rate * k]
    return held[-1] if held else se.LAST + 1


def test_step_up():
    assert se.step_up({}) == se.LAST + 1
    r = random.Random(9)
    for _ in range(200):
        places = [r.choice((0, 3, 20, 30, 60, 90)) for _ in range(r.randint(1, 40))]
        assert se.step_up({q: places.count(q) for q in places}, 0.05) == slow_step_up(places, 0.05)


WORDS = "report account user value return index water coast model height scene tide harbour north window second minute planet garden bridge letter market".split()


def tokens(seed, n):
    """(kind, token) of random and structured tokens of 20 signs or more."""
    r = random.Random(seed)
    pick = lambda k: [r.choice(WORDS) for _ in range(k)]
    draw = lambda name, k: "".join(r.choices(dict(se.ENCODINGS)[name], k=k))
    makers = {
        "base64": lambda: draw("base64", 40), "base36": lambda: draw("base36", 40), "base64url": lambda: draw("base64url", 43),
        "words": lambda: "".join(pick(4)) + str(r.randint(1, 9999)), "camel": lambda: "".join(w.capitalize() for w in pick(5)) + str(r.randint(1, 99)),
        "slug": lambda: "-".join(pick(5)) + f"-{r.randint(1, 2030)}", "path": lambda: "/".join(pick(5)) + str(r.randint(1, 9)), "const": lambda: "_".join(pick(5)).upper() + "_7",
        "dated": lambda: f"S2B_MSIL2A_2024{r.randint(1001, 1231)}T{r.randint(100000, 235959)}_N0510_R037_T29TPJ",
    }
    return [(kind, make()) for kind, make in makers.items() for _ in range(n)]


def test_planted_tokens_and_error_rates(spark):
    """Added spans are those of a plain version; random tokens are found, and few of what is reported is structured."""
    made = [(i, kind, t) for i, (kind, t) in enumerate(tokens(4, 120)) if len(t) >= se.SHORTEST]
    df = spark.createDataFrame([(i, f"see <{t}> there") for i, _, t in made], "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in se.find_secrets(df).collect()}
    found = {i: se.scan(f"see <{t}> there")[1] for i, _, t in made}
    firsts = [slow_step_up([q for c in found.values() for a, b, q in c if se.stratum(b - a) == k], se.RATE) for k in range(len(se.STRATA))]
    for i, _, _ in made:
        want = [f"random:{a}:{b}" for a, b, q in found[i] if q >= firsts[se.stratum(b - a)]]
        assert got[i].spans == ",".join(want) and got[i].n_random == len(want)
    share = lambda kinds: np.mean([got[i].n_random > 0 for i, kind, _ in made if kind in kinds])
    assert share({"base64", "base36", "base64url"}) > 0.85
    assert share({"words", "camel", "slug", "path", "const", "dated"}) < 0.01


def test_added_spans_keep_base_ones(spark, docs, empty):
    r = random.Random(3)
    token = "".join(r.choices(dict(se.ENCODINGS)["base64"], k=44))
    df = spark.createDataFrame([(1, f"see {token} and {'x1' * 20} password=abcdefgh12"), (1, f"see {token}"), (None, None)], "doc_id int, text string")
    got = sorted(r.spans for r in se.find_secrets(df).collect())
    assert got == ["", "random:4:48", "random:4:48,assign:94:113"]
    got = se.find_secrets(docs).collect()
    assert len(got) == len(corpus()) and all(r.n_assign + r.n_access + r.n_hex == 0 for r in got if r.doc_id in (6, 7, 9))
    assert se.find_secrets(empty).count() == 0


def reported(text):
    """Spans of candidates that would be reported if they were the only ones."""
    return [(a, b) for a, b, q in se.scan(text)[1] if q >= se.step_up({q: 1})]


def test_random_values_after_a_sign():
    value = "KBKn00PkHup8/c3MysRDRQiX++Ncai8tx5uJBeL2"
    url = value.translate(str.maketrans("+/", "-_"))
    for text, token in (
        (f"AWS_SECRET_ACCESS_KEY={value}", value),
        (f"https://a.example/x?sig={value}==&n=1", value + "=="),
        (f"sessionid={url}; path=/", url),
        (f"a=b=={value}", value),
        (f"client_id/{value}", "id/" + value),
        (f"users/{url}", url),
    ):
        assert se.scan(text)[0] == [] and [text[a:b] for a, b in reported(text)] == [token], text


def test_structured_pieces_stay_out():
    assert reported("path=/usr/lib/python3-dist_packages/aaaaaaaaaaaaaaaaaaaaaaaa1/x") == []
