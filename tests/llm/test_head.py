"""Pages that leave out the end of the head or the begin of the body."""

import pytest

from sensorloom.llm.html_text import parse


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<head><title>No</title><p>Text", ["Text"]),
        ("<html><head><meta charset=utf-8>\n<title>No</title>\n<link href=x>Bare text", ["Bare text"]),
        ("<head><title>No</title><style>p{}</style><b>Bold</b> text<p>More", ["Bold text", "More"]),
        ("<head><script>var x = '<p>no</p>'</script><!-- no --><noframes>No</noframes><article>Yes</article>", ["Yes"]),
        ("<head><title>No</title></head><body><p>Text</p></body>", ["Text"]),
        ("<head><title>No</title>\n", []),
    ],
)
def test_head_ends_where_its_content_does(page, blocks):
    assert parse(page).blocks == blocks
