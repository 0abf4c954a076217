"""Pages whose silent elements are not closed keep their text."""

import pytest

from braidline.llm import warc

PAGES = {
    "no </head>, body": ("<html><head><title>T</title><body><p>One<div>Two</div></body></html>", "One\nTwo"),
    "no </head>, no body": ("<head><meta charset=utf-8><title>T</title><p>One<p>Two", "One\nTwo"),
    "no </head>, text": ("<head><title>T</title>One<p>Two", "One\nTwo"),
    "no </head>, script and style": ("<head><script>x()</script><style>p{}</style><title>T</title><h1>One</h1>", "One"),
    "no </head>, open noscript": ("<head><noscript><link><body><p>One", "One"),
    "closed head": ("<head><title>T</title></head>One<p>Two", "One\nTwo"),
    "head only": ("<head><title>T</title>", ""),
    "open noscript": ("<body><p>One<noscript><p>Two<p>Three", "One\nTwo\nThree"),
    "open template": ("<p>One<template><p>Two", "One\nTwo"),
    "open template before a closed one": ("<p>One<template><p>Two<template><p>Not</template><p>Three", "One\nTwo\nThree"),
    "nested templates": ("<p>One<template>a<template>b</template>c</template><p>Two", "One\nTwo"),
    "open svg": ("<p>One<svg><text>Not<p>Two", "One\nTwo"),
    "svg with html inside": ("<p>One<svg><foreignObject><div>Not</div></foreignObject><text>Nor</text></svg><p>Two", "One\nTwo"),
    "open script": ("<p>One<script>x()", "One"),
    "closed ones": ("<p>One<noscript><p>Not</noscript><svg><text>Nor</text></svg>Two", "One\nTwo"),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_after_an_open_element(name):
    html, want = PAGES[name]
    assert warc.plain_text(html) == want


def test_conversion_of_a_page_without_head_end(spark):
    page = spark.createDataFrame([(1, "http://a.example/", PAGES["no </head>, body"][0])], "page_id long, url string, html string")
    assert [r.content for r in warc.derive_pages(page).collect() if r.type == "conversion"] == ["One\nTwo"]
