"""Column expressions on hand-made values."""

import random

import pytest

from msgloom.functions.body_text import JUNK_PREFIXES, inferred_text, marked_text, structured_text
from msgloom.functions.keys import contact_key, email_key, phone_key
from msgloom.functions.labels import REACTIONS, effect_label, reaction_label
from msgloom.functions.links import link_domain, link_token
from msgloom.functions.text import UNICODE_WHITESPACE, trim_unicode
from msgloom.sources.derived import stream_blob

HEAD = b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSAttributedString\x00\x84\x84\x08NSObject\x00\x85\x92"
STRING = b"\x84\x84\x84\x08NSString\x01\x94\x84\x01+"
TAIL = b"\x86\x84\x02iI\x01\x0a\x92\x84\x84\x84\x0cNSDictionary\x00\x95\x84\x01i\x01\x92"


def stream(payload: bytes, length: bytes | None = None) -> bytes:
    if length is None:
        size = len(payload)
        length = bytes([size]) if size < 128 else b"\x81" + size.to_bytes(2, "little")
    return HEAD + STRING + length + payload + TAIL


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["o"] for r in df.selectExpr("i", f"{expression} AS o").orderBy("i").collect()]


def texts(spark, blobs):
    return apply(spark, blobs, inferred_text("v"), "binary")


@pytest.mark.parametrize(
    "blob, expected",
    [
        (b"", None),
        (None, None),
        (b"hello world", None),
        (b"...NSStringhello world NSDictionary...", "hello world"),
        (b"...NSString+2actual messageNSDictionary...", "actual message"),
        (b"...NSString+\niIactual messageNSDictionary...", "actual message"),
        (b"...NSString\x80\x9f\xfehello NSDictionary...", "hello"),
        (b"NSString+2 iINSDictionary", None),
        (b"NSString a NSDictionary b NSDictionary", "a"),
        (b"NSDictionary NSString x", None),
        (b"NSStringa\r\nbNSDictionary", "a \nb"),
        (stream(b"Short note"), "Short note"),
        (stream(b"  \n padded\t"), "padded"),
        (stream("café ☃ \U0001f600".encode()), "café ☃ \U0001f600"),
        (stream(b"x" * 127), "x" * 127),
        (stream(b"x" * 128), "x" * 128),
        (stream("é".encode() * 40000, b"\x82" + (80000).to_bytes(4, "little")), "é" * 40000),
        (stream(b"\x86\x84 inside"), None),  # not UTF-8; nothing readable is left between the markers but the tag
    ],
)
def test_body_text(spark, blob, expected):
    (got,) = texts(spark, [blob])
    if blob is not None and b"\x86\x84 inside" in blob:
        assert got != "\x86\x84 inside"
    else:
        assert got == expected


def test_strings_that_are_no_body_fall_back_to_the_markers(spark):
    blobs = [stream(b""), stream(b"__kPart"), stream(b"xAttributeName"), HEAD + STRING + b"\x50short"]
    assert apply(spark, blobs, structured_text("v"), "binary") == [None] * 4
    assert texts(spark, blobs) == apply(spark, blobs, marked_text("v"), "binary")
    assert texts(spark, blobs)[0] is None and texts(spark, blobs)[3] is None


def test_many_junk_prefixes_do_not_overflow(spark):
    blob = b"NSString" + b"iI " * 100_000 + b"+(end" + b"NSDictionary"
    assert texts(spark, [blob]) == ["end"]


def test_marked_text_against_brute_force(spark):
    rng = random.Random(5)
    pieces = [p.encode() for p in JUNK_PREFIXES] + [b" ", b"\n", b"a", b"+", b"i", b"I", b"\x00", b"\xff", b"\t"]

    def strip(data: bytes) -> str | None:
        text = "".join(chr(b) if 0x20 <= b <= 0x7E or b in b"\n\t" else " " for b in data).strip(" \n\t")
        while any(text.startswith(p) for p in JUNK_PREFIXES):
            text = text[2:].lstrip(" \n\t")
        return text or None

    bodies = [b"".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(400)]
    assert texts(spark, [b"NSString" + b + b"NSDictionary" for b in bodies]) == [strip(b) for b in bodies]


def test_derived_streams_can_be_read_back(spark):
    sizes = [1, 127, 128, 255, 256, 65535, 65536, 200_000]
    df = spark.createDataFrame([(n, "y" * n) for n in sizes], "n int, t string")
    blobs = df.selectExpr("n", f"{stream_blob('t')} AS v")
    assert all(r["same"] for r in blobs.selectExpr(f"length({inferred_text('v')}) = n AS same").collect())


def test_trim_covers_unicode_white_space(spark):
    assert len(UNICODE_WHITESPACE) == 25
    assert apply(spark, [UNICODE_WHITESPACE + "a b" + UNICODE_WHITESPACE], trim_unicode("v")) == ["a b"]


LINKS = {
    "see https://www.Example.com/a.": "example.com",
    "http://first.org then https://second.org/x": "second.org",
    "http://only.org:8080/x?y#z": "only.org",
    "(https://in.paren.org) rest": "in.paren.org",
    "https://user:p@ss@host.org/x": "host.org",
    "https://cdn_1.example.net, next": "cdn_1.example.net",
    "https://a.org!?": "a.org",
    "https://www.www.org": "www.org",
    "https://Bücher.example/x": "bücher.example",
    "https://host.org next": "host.org",
    "https://[::1]:80/x": "[::1]",
    "https://host.org?q=1": "host.org",
    "https:///slashes.org/x": "slashes.org",
    "https://": None,
    "https:// gap": None,
    "https://host:99999/x": None,
    "https://host:65535/x": "host",
    "https://host:00080": "host",
    "https://host:abc/x": None,
    "https://ho<st/x": None,
    "no link": None,
    "HTTPS://upper.org": None,
    "line\nhttps://second.line.org\nmore": "second.line.org",
}


def test_link_domain(spark):
    assert dict(zip(LINKS, apply(spark, list(LINKS), link_domain("v")), strict=True)) == LINKS


def test_link_in_a_long_text_is_found_whole(spark):
    text = "word " * 200_000 + "http://end.example.org/path."
    assert apply(spark, [text], link_token("v")) == ["http://end.example.org/path"]
    assert apply(spark, [text], link_domain("v")) == ["end.example.org"]


def test_labels(spark):
    codes = [*REACTIONS, 0, 2006, 10**12, None]
    assert apply(spark, codes, reaction_label("v"), "bigint") == [*REACTIONS.values(), *["no-reaction"] * 4]
    styles = {
        None: "no-effect", "": "no-effect", "a.": "no-effect", "impact": "impact", "x.y.CKEchoEffect": "Echo",
        "x.CKEffect": "", "CKEffectCK.a": "a",
    }
    assert apply(spark, list(styles), effect_label("v")) == list(styles.values())


def test_contact_keys(spark):
    phones = {"+1 (415) 555-0001": "+14155550001", " +1": "1", "1+2+3": "123", "++4": "+4", "": "", "٣": ""}
    assert apply(spark, list(phones), phone_key("v")) == list(phones.values())
    assert apply(spark, ["Ann@X.Org"], email_key("v")) == ["ann@x.org"]
    assert apply(spark, ["Ann@X.Org", "+1 2"], contact_key("v")) == ["ann@x.org", "+12"]


def test_later_strings_of_a_stream(spark):
    back = b"\x86\x92\x84\x98\x98"  # a later string refers back to class and type of the first
    firsts = [b"", b"__kIMMessagePart", b"xAttributeName", b" \n"]
    blobs = [HEAD + STRING + bytes([len(f)]) + f + back + b"\x05Hello" + TAIL for f in firsts]
    blobs.append(HEAD + STRING + b"\x02__" + back + b"\x03__b" + back + b"\x04Last" + TAIL)
    blobs.append(HEAD + STRING + b"\x03Yes" + back + b"\x05Hello" + TAIL)
    assert apply(spark, blobs, structured_text("v"), "binary") == ["Hello"] * 4 + ["Last", "Yes"]


class Writer:
    """Writes object streams, with the strings they share."""

    def __init__(self):
        self.out, self.strings = b"\x04\x0bstreamtyped\x81\xe8\x03", []

    def size(self, n: int) -> bytes:
        return bytes([n]) if n < 128 else b"\x81" + n.to_bytes(2, "little") if n < 65536 else b"\x82" + n.to_bytes(4, "little")

    def shared(self, text: bytes) -> "Writer":
        if text in self.strings:
            self.out += bytes([0x92 + self.strings.index(text)])
        else:
            self.strings.append(text)
            self.out += b"\x84" + self.size(len(text)) + text
        return self

    def raw(self, data: bytes) -> "Writer":
        self.out += data
        return self

    def opened(self, *classes: bytes) -> "Writer":
        self.out += b"\x84"
        for name in classes:
            self.raw(b"\x84").shared(name).raw(b"\x01")
        return self.raw(b"\x85")

    def string(self, text: bytes) -> "Writer":
        return self.shared(b"+").raw(self.size(len(text)) + text)


def test_streams_are_read_by_their_grammar(spark):
    tag = b"\x84\x01+\x04fake"

    def begun():
        return Writer().shared(b"@").opened(b"Odd", b"NSObject")

    cases = [
        # Tags inside data of fixed size, a class name, a C string, and a string that is no body.
        (begun().shared(b"[%dc]" % len(tag)).raw(tag).string(b"true").raw(b"\x86"), "true"),
        (Writer().shared(b"@").opened(b"Odd" + tag, b"NSObject").string(b"true").raw(b"\x86"), "true"),
        (begun().shared(b"*").raw(b"\x84").shared(tag).string(b"true").raw(b"\x86"), "true"),
        (begun().string(b"__" + tag).string(b"true").raw(b"\x86"), "true"),
        (begun().shared(b"[%dc]" % len(tag)).raw(tag).raw(b"\x86"), None),
        # Numbers of all widths, reals, structures, nil, references, nested objects, types used again.
        (begun().shared(b"isq").raw(b"\x81\xff\x7f\x82" + tag[:4] + b"\x05").string(b"true").raw(b"\x86"), "true"),
        (begun().shared(b"fdc").raw(b"\x83" + tag[:4] + b"\x83" + tag + b"+").string(b"true").raw(b"\x86"), "true"),
        (begun().shared(b"{P={Q=ii}f}").raw(b"\x01\x02\x03").string(b"true").raw(b"\x86"), "true"),
        (begun().shared(b"@").raw(b"\x85").shared(b"@").raw(b"\x93").shared(b"#").raw(b"\x85").string(b"true").raw(b"\x86"), "true"),
        (begun().shared(b"@").opened(b"In").shared(b"i").raw(b"\x07\x86").string(b"").string(b" true ").raw(b"\x86"), "true"),
        # A grammar that breaks: strings are looked for by their tags.
        (begun().shared(b"~").raw(b"\x01").string(b"by tag").raw(b"\x86"), "by tag"),
        (begun().string(b"\xff" + tag).string("t\u00e9".encode() * 300).raw(b"\x86"), "t\u00e9" * 300),
        (begun().shared(b"i").raw(b"\x01\x86").string(b"true"), "true"),
    ]
    found = apply(spark, [w.out for w, _ in cases], structured_text("v"), "binary")
    assert found == [expected for _, expected in cases]


def test_more_shared_strings_than_a_byte_can_name(spark):
    w = Writer().shared(b"@").opened(b"Odd")
    names = [b"C%d" % i for i in range(150)]
    for name in names:
        w.shared(b"@").raw(b"\x84\x84").shared(name).raw(b"\x00\x85\x86")
    w.strings.append(b"+")
    w.raw(b"\x84\x01+\x00")  # string 152 is the type of strings
    w.raw(b"\x81" + (len(w.strings) - 1 - 110).to_bytes(2, "little", signed=True) + b"\x04true\x86")
    assert apply(spark, [w.out], structured_text("v"), "binary") == ["true"]


def test_a_long_stream_of_many_symbols(spark):
    w = Writer().shared(b"@").opened(b"Odd").shared(b"i" * 100)
    w.raw(b"\x07" * 100)
    for _ in range(200):
        w.shared(b"i" * 100).raw(b"\x07" * 100)
    assert apply(spark, [w.string(b"x" * 70_000).out], structured_text("v"), "binary") == ["x" * 70_000]
