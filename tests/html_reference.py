"""Text of an HTML document with the standard library's parser, for tests."""

from html.entities import html5
from html.parser import HTMLParser

NAMES = {name.rstrip(";"): text for name, text in html5.items()}
HIDDEN = {"script", "style", "template", "rt", "rp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "wbr"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not HIDDEN & set(self.open):
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(NAMES.get(name, "&" + name))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        try:
            text = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
        except UnicodeDecodeError:
            text = chr(code)
        except (ValueError, OverflowError):
            text = "�"
        self.handle_data(text)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])


def html_text(html):
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)
