"""Whole license wordings, against regular expressions over the words as a second matcher."""

import random
import re

import pytest

from loomtable.llm import licenses

_PART = re.compile(r"(<<optional>>|<</optional>>|<<var:\d+>>)")


def _words(x: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", x.lower())


def _pattern(template: str) -> re.Pattern:
    out = ""
    for x in _PART.split(template):
        if x == "<<optional>>":
            out += "(?:"
        elif x == "<</optional>>":
            out += ")?"
        elif x.startswith("<<var"):
            out += f"(?:[^ ]+ ){{0,{int(x[6:-2])}}}"
        else:
            out += "".join(f"{w} " for w in _words(x))
    return re.compile("(?:^|(?<= ))" + out)


def _text(template: str, dice: random.Random) -> list[str]:
    """Words that the template accepts (optional regions aren't nested here)."""
    out, skip = [], False
    for x in _PART.split(template):
        if x == "<<optional>>":
            skip = dice.random() < 0.5
        elif x == "<</optional>>":
            skip = False
        elif x.startswith("<<var"):
            out += [dice.choice(["acme", "the", "2", "holders"]) for _ in range(dice.randint(0, int(x[6:-2])))]
        elif not skip:
            out += _words(x)
    return out


def test_labels_equal_second_matcher(spark):
    """Accepted wordings keep their label; a word that is missing, added or another anywhere is judged alike by both matchers."""
    dice = random.Random(5)
    texts = []
    for _, t in licenses.TEMPLATES:
        for k in range(24):
            w = _text(t, dice)
            at = dice.randrange(len(w))
            w = [w, w[:at] + w[at + 1 :], [*w[:at], "zebra", *w[at:]], [*w[:at], "zebra", *w[at + 1 :]]][k % 4]
            texts.append(" ".join(["before", *w, "after"][dice.randint(0, 1) :]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["n_templates"]) for r in licenses.scan(rows).collect()}
    patterns = [(label, _pattern(t)) for label, t in licenses.TEMPLATES]
    seen = set()
    for k, x in enumerate(texts):
        hits = [label for label, p in patterns if p.search(x + " ")]
        base = {label for phrase, label in licenses.BASE_PHRASES.items() if f" {phrase} " in f" {x} "}
        assert got[k] == (",".join(sorted(base | set(hits))), len(hits)), x
        seen.add(len(hits))
    assert {0, 1} <= seen


def test_later_clauses_are_mandatory(spark):
    """Wordings whose last clauses are cut or altered aren't accepted, and the variants of one family are told apart."""
    whole = {t: label for label, t in licenses.TEMPLATES}
    clean = lambda t: re.sub(r"<<var:\d+>>", " x ", re.sub(r"<<optional>>.*?<</optional>>", " ", t, flags=re.S))
    long = [t for t in whole if len(t) > 400]
    rows = []
    for k, t in enumerate(long):
        w = clean(t).split()
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w[:-1])), (3 * k + 2, " ".join([*w[:-3], "never", *w[-2:]]))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(long):
        others = 1 if whole[t] == "apache" else 0  # the notice begins with the one of a line
        assert got[3 * k]["n_templates"] == 1 + others and whole[t] in got[3 * k]["labels"].split(",")
        assert got[3 * k + 1]["n_templates"] == others and got[3 * k + 2]["n_templates"] == others
    assert {got[3 * k]["labels"] for k, t in enumerate(long) if whole[t].startswith("bsd")} == {"bsd-2-clause", "bsd-3-clause"}


def test_no_region_at_the_end():
    for bad in ("a <<var:1>>", "a <<optional>>b<</optional>>", "a <<optional>>b<</optional>> <<var:2>>"):
        with pytest.raises(ValueError):
            licenses.TokenAutomaton(bad)
