"""Page text where end tags are omitted or cross."""

import pytest

from corpusloom.llm import htmltext

ARTICLE = "<article><h1>Title here</h1><p>One sentence of the article, long enough.</p><p>And another one, with a comma.</p></article>"
WANT = ["Title here", "One sentence of the article, long enough.", "And another one, with a comma."]


@pytest.mark.parametrize("start", [
    "<html><head><title>T</title><body>", "<head><meta charset=utf-8><link rel=x><style>a{}</style>", "<head><head><title>T</title><body>",
    "<html><head><title>T</title><noscript><p>Enable JS<body>", "<head><script>1<2</script><div></div>", "<head><title>T</title></head><body>",
    "<body><noscript><p>Enable JS</noscript>", "<body><button><div>Go</button>", "<body><object><p>x</object>", "<body><template><ul><li>x</template>", "<body></noscript></template>",
])
def test_the_article_is_read(start):
    assert [b.text for b in htmltext.leaf_blocks(start + ARTICLE)] == WANT


def test_text_ends_an_open_head():
    assert [b.text for b in htmltext.leaf_blocks("<head><title>T</title>\n Some text<p>More")] == ["Some text", "More"]
    assert htmltext.leaf_blocks("<head><title>T</title><noscript><img src=x></noscript><meta name=a></head>") == []
