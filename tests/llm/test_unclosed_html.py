"""Elements without an end tag do not swallow a page."""

import pytest

from quarrykit.llm.block_lstm import blocks

BODY = "<article><p>One text.</p><p>Two text.</p></article>"


@pytest.mark.parametrize("head", [
    "<html><head><title>t</title><body>", "<html><head><title>t <b></title><meta charset=x><link rel=y><script>var a</script><style>b</style>",
    "<html><head><body>", "<head><title>t</title></head><body>", "<HEAD\n><TITLE>t</TITLE>", "<head><!-- c --><noscript><link></noscript></head>", "<body><svg viewBox='0' />", '<svg aria-label="a>b"/>', "<math/>",
    "<svg><path d='x'/></svg>", "<svg><title>hidden</title><text>x</text></svg>", "<svg><path d='x'>", "<object data=x>", "<svg/><svg><text>x</text></svg><svg />", "<object>fallback</object>", "<noscript>off</noscript>",
])
def test_page_text_stays(head):
    assert [t for _, t, _ in blocks(head + BODY)] == ["One text.", "Two text."]


def test_raw_text_ends_the_page():
    assert [t for _, t, _ in blocks("<p>One</p><script>var a = '<p>no</p>'")] == ["One"]
    assert [t for _, t, _ in blocks("<head>Loose text<p>One</p>")] == ["Loose text", "One"]
