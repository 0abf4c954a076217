"""Private keys are found and masked as a whole, not by their first line."""

import base64
import random

import pytest

from braidline.llm import secrets

BODY = base64.b64encode(random.Random(12).randbytes(1190)).decode()
LINES = [BODY[i:i + 64] for i in range(0, len(BODY), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
HEAD = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
LONG = "\n".join(LINES * 2000)
TEXTS = {
    "whole": ("my key\n" + "\n".join([BEGIN, *LINES, END]) + "\nand more", "my key\n[SECRET]\nand more"),
    "windows lines": ("a " + "\r\n".join([BEGIN, *LINES, END]) + " b", "a [SECRET] b"),
    "escaped": ('{"k": "' + "\\n".join([BEGIN, *LINES, END]) + '\\n"}', '{"k": "[SECRET]\\n"}'),
    "encrypted": ("x\n" + BEGIN + "\n" + HEAD + "\n".join([*LINES, END]) + "\ny", "x\n[SECRET]\ny"),
    "two": ("\n".join([BEGIN, *LINES, END, "between", BEGIN, *LINES, END]), "[SECRET]\nbetween\n[SECRET]"),
    "no end": ("x\n" + "\n".join([BEGIN, *LINES, "Some words that follow."]), "x\n[SECRET]\nSome words that follow."),
    "no end, encrypted": (BEGIN + "\n" + HEAD + "\n".join(LINES), "[SECRET]"),
    "no end, escaped": ("'" + "\\n".join([BEGIN, *LINES]) + "' tail", "'[SECRET]' tail"),
    "no end, short last line": ("\n".join([BEGIN, *LINES[:-1], "Qw3r", "Some words that follow."]), "[SECRET]\nSome words that follow."),
    "no end, one line": (" ".join([BEGIN, *LINES[:-1], "Qw3r==", "rest"]), "[SECRET] rest"),
    "no end, then another": ("\n".join([BEGIN, *LINES, BEGIN, *LINES, END]), "[SECRET]\n[SECRET]"),
    "other end": ("\n".join([BEGIN, *LINES, "-----END PRIVATE KEY-----"]), "[SECRET]\n-----END PRIVATE KEY-----"),
    "one line": (" ".join([BEGIN, *LINES, END, "rest"]), "[SECRET] rest"),
    "marker alone": (f"a file starts with {BEGIN} and a line of text", "a file starts with [SECRET] and a line of text"),
    "very long": (f"{BEGIN}\n{LONG}\n{END}\nz", "[SECRET]\nz"),
    "very long, no end": (f"{BEGIN}\n{LONG}\n", "[SECRET]\n"),
    "none": ("no key here", "no key here"),
}


@pytest.fixture(scope="module")
def clean(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id string, text string")
    return {r.doc_id: r.text for r in secrets.redact(docs).collect()}


@pytest.mark.parametrize("name", TEXTS)
def test_redact_removes_the_key(clean, name):
    assert clean[name] == TEXTS[name][1]


def test_span_holds_the_key(spark):
    docs = spark.createDataFrame([("a", TEXTS["whole"][0])], "doc_id string, text string")
    pem = [s for s in secrets.find_secrets(docs).first().spans.split(",") if s.startswith("pem:")]
    text = TEXTS["whole"][0]
    assert pem == [f"pem:{text.index(BEGIN)}:{text.index(END) + len(END)}"]
