"""An example of every alternative of every license rule, gated and ungated."""

import re._constants as c
import re._parser as parser

from skyledger.llm import licenses
from tests.llm.test_operators import brute_licenses


def variants(nodes):
    """Texts in which each choice of a pattern is taken at least once, one choice varied at a time."""
    each = []
    for op, arg in nodes:
        if op is c.LITERAL:
            each.append([chr(arg)])
        elif op is c.IN:
            kind, value = arg[0]
            each.append([chr(value if kind is c.LITERAL else value[0])] if kind is not c.CATEGORY else ["x"])
        elif op is c.BRANCH:
            each.append([v for branch in arg[1] for v in variants(branch)])
        elif op is c.SUBPATTERN:
            each.append(variants(arg[3]))
        elif op is c.MAX_REPEAT:
            least, _, inner = arg
            each.append([*([""] if least == 0 else []), *variants(inner)])
        else:
            raise AssertionError(op)
    base = [e[0] for e in each]
    return ["".join(base)] + ["".join([*base[:k], v, *base[k + 1 :]]) for k, e in enumerate(each) for v in e[1:]]


def test_every_alternative_passes_the_gate(spark):
    texts = sorted({" ".join(v.split()) for _, pattern, *_ in licenses.rules() for v in variants(parser.parse(pattern))})
    assert len(texts) > 1000 and {"q public license", "copyrighted by", "beer ware license", "expat license"} <= set(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(df, "text", {"doc_id": "doc_id"}).collect()}
    wrong = [t for i, t in enumerate(texts) if got[i] != brute_licenses(t)]
    assert not wrong, wrong[:20]
