"""Titles in headers of articles, noisy wrappers and elements that are never closed."""

from gaitline.llm import html_text

LONG = "Some long text of the body that goes on and on, for quite a while and so on and on and on again."


def test_weak_class_words():
    want = f"Title\n\n{LONG}"
    for head in ("<header class='entry-header'><h1>Title</h1></header>", "<div class='article-header'><h1>Title</h1></div>"):
        assert html_text.extract(f"<body><article>{head}<p>{LONG}</p></article></body>") == want
    for wrapper in ("content has-sidebar", "page sidebar"):
        assert html_text.extract(f"<body><div class='{wrapper}'><h1>Title</h1><p>{LONG}</p></div></body>") == want
    assert html_text.extract(f"<body><div class='menu'>Home</div><div><h1>Title</h1><p>{LONG}</p></div></body>") == want


def test_skips_end_at_enclosing_elements():
    want = f"Title\n\n{LONG}"
    assert html_text.extract(f"<html><head><meta charset=x><body><h1>Title</h1><p>{LONG}</p></body>") == want
    assert html_text.extract(f"<article><h1>Title</h1><div><form><input></div><p>{LONG}</p></article>") == want
    assert html_text.extract(f"<article><div><h1>Title</h1></div><aside><div>No</div></aside><p>{LONG}</p></article>") == want
