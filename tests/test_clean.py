import pytest
from corpusflow.functions import clean
from corpusflow.functions.text import WHITESPACE, strip, words


def test_whitespace_is_what_python_strips(value):
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    padded = WHITESPACE + "a" + WHITESPACE + "b" + WHITESPACE
    assert value(strip, padded) == padded.strip()
    assert value(words, padded) == ["a", "b"]
    assert value(words, " \n\t ") == []
    assert value(words, "one  two\nthree\tfour ") == ["one", "two", "three", "four"]
    assert value(words, "a\u200bb\u00a0c") == ["a\u200bb", "c"]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("[a]b\nkept line", "kept line"),
        ("  [z] keep?\nkept line", "kept line"),
        ("x \\cite{k} y", "x k y"),
        ("ab\nabc", "abc"),
        ("document\ndocuments", "documents"),
        ("\\begin{abstract}text here\\end{abstract}", "text here"),
        ("\\usepackage{a}\\documentclass[b]{c} rest", "documentclass[b]c rest"),
        ("\\section*{Title} \\subsection{Sub}", "Title Sub"),
        ("\\alpha_{x}   and\tmore", "alpha_x and\tmore"),
        ("one\n\n\n\ntwo", "one\ntwo"),
        ("\\begin{a\nb} stays", "begina\nb stays"),
        ("line\u2028same line [not option]", "line\u2028same line [not option]"),
        ("[opt\u2028] gone\nkept", "kept"),
        ("", ""),
    ],
)
def test_cleaning_cases(value, raw, cleaned):
    assert value(clean.clean_text, raw) == cleaned


def test_single_steps(value):
    assert value(clean.drop_option_lines, "a [b]\n[c] d\n e") == "a [b]\n\n e"
    assert value(clean.collapse_spaces, "a   b \t  c") == "a b \t c"
    assert value(clean.collapse_newlines, "a\n\n\n\nb\n\nc") == "a\n\nb\n\nc"
    assert value(clean.drop_braces, "{a{b}}") == "ab"


def test_null_text(value):
    assert value(clean.clean_text, None) is None
