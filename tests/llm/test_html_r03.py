"""Operator 9 on deeply nested and unclosed markup, and on paragraphs whose class is a word of noise."""

import time

import pytest

from gaitline.llm import html_text

TEXT = "Some words of the article stand here, and more of them follow. " * 8


@pytest.mark.parametrize("page", ['<div class="ad">line of text\n' * 20000, "<textarea>x" * 20000, "<a>" + "<div>x</a>" * 20000, "<form>" * 10000 + "<header>x" * 10000])
def test_nesting_costs_no_more_than_length(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 4  # about half a second; with each line asking all blocks around it, minutes


def test_a_class_word_alone_drops_no_paragraph_of_an_article():
    page = f'<body><article><h1>Title</h1><p>{TEXT}</p><p class="comment">Our comment on this is short.</p><p>{TEXT}</p><div class="comments"><p>First!</p></div></article><p class="ad">Buy this</p></body>'
    found = html_text.extract(page)
    assert "Our comment on this is short." in found and "Buy this" not in found and "First!" not in found
