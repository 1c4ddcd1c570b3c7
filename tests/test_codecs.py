import math

import pytest
from hypothesis import given, strategies as st

from cairnmark.functions import multibase, names, node
from cairnmark.functions.cid import CID, get_varint, put_varint

VECTORS = [
    (2, "uAXEAAQI"), (27, "uAXEAAhgb"), (None, "uAXEAAfY"), (True, "uAXEAAfU"), (128758927483, "uAXEACRsAAAAd-qFQew"),
    (6.283, "uAXEACftAGSHKwIMSbw"), ("∞", "uAXEABGPiiJ4"), (b"\x55\xaa", "uAVUAAlWq"), ([1, 2, 3], "uAXEABIMBAgM"),
    ({"foo": "bar", "oof": "rab"}, "uAXEAEaJjZm9vY2JhcmNvb2ZjcmFi"), (CID.parse("uAXEAAhgb"), "uAXEACtgqRwABcQACGBs"),
    ("cookie", "uAXEAB2Zjb29raWU"), ([2, 3, 5, 7, 11], "uAXEABoUCAwUHCw"), ({"unary": "test"}, "uAXEADKFldW5hcnlkdGVzdA"),
    (list(range(1024)), "uAXGg5AIg6aa9gvagXHAJtTCI5l_QXWbIMNnQN6905en1kSnHNPo"),
]
NODES = st.recursive(
    st.none() | st.booleans() | st.integers(node.INT_MIN, node.UINT_MAX) | st.floats(allow_nan=False) | st.text() | st.binary(),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12,
)


@pytest.mark.parametrize(("value", "cid"), VECTORS)
def test_golden_cids(value, cid):
    got, content = node.to_ipld(value)
    assert str(got) == cid
    assert node.from_ipld(got, content) == value


def test_hash_choice():
    assert node.to_ipld(bytes(range(34)))[0].is_identity
    c = node.to_ipld(bytes(range(35)))[0]
    assert not c.is_identity
    assert c.data.hex() == "0155a0e4022013891b823d3a2cfe0d1a5e60fe89d8c091524f994cdc3241c4da19c4bb3c2c6b"
    assert CID.calculate(0x71, b"\xf6", 0xB220).data.hex() == "0171a0e4022001f4b788593d4f70de2a45c2e1e87088bfbdfa29577ae1b62aba60e095e3ab53"
    assert CID.from_bytes(bytes.fromhex("0001710001f6")).data == bytes.fromhex("01710001f6")
    assert node.to_ipld({"a": node.UINT_MAX})[0].content_type == 0x0171
    assert node.to_ipld([math.inf])[0].content_type == 0x0171


@pytest.mark.parametrize(("value", "data"), [
    (24, "1818"), (1000, "1903e8"), (node.UINT_MAX, "1bffffffffffffffff"), (-1, "20"), (-1000, "3903e7"), (node.INT_MIN, "3b7fffffffffffffff"),
    (1.1, "fb3ff199999999999a"), (-0.0, "fb8000000000000000"), (math.nan, "fb7ff8000000000000"), (-math.inf, "fbfff0000000000000"),
])
def test_cbor_vectors(value, data):
    assert node.to_cbor(value).hex() == data


def test_cbor_map_order():
    keys = ["ooo", "bb", "", "\x80", "a", "ccc", "nn", "m"]
    assert list(node.from_cbor(node.to_cbor(dict.fromkeys(keys, 0)))) == ["", "a", "m", "bb", "nn", "\x80", "ccc", "ooo"]


@pytest.mark.parametrize("data", ["18", "1c", "ff", "5f6161ff", "5f5f4161ffff", "bf6161ff", "3b8000000000000000", "a10000", "61ff", "0000", "c100", "d82a4101"])
def test_cbor_rejects(data):
    with pytest.raises(ValueError):
        node.from_cbor(bytes.fromhex(data))


@pytest.mark.parametrize(("data", "value"), [("5f41614162ff", b"ab"), ("7f61616162ff", "ab"), ("9f0102ff", [1, 2]), ("bf616101ff", {"a": 1}), ("f93c00", 1.0), ("fa3fc00000", 1.5), ("f7", None), ("a2616101616102", {"a": 2})])
def test_cbor_lenient_reads(data, value):
    assert node.from_cbor(bytes.fromhex(data)) == value


@given(NODES)
def test_round_trips(v):
    assert node.from_cbor(node.to_cbor(v)) == v
    assert node.from_json(node.to_json(v)) == v
    cid, content = node.to_ipld(v)
    assert node.from_ipld(CID.parse(str(cid)), content) == v


@pytest.mark.parametrize(("x", "text"), [
    (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (2.0**68, "295147905179352830000"), (1e21, "1e+21"),
    (9.999999999999997e-7, "9.999999999999997e-7"), (1e-6, "0.000001"), (-0.0, "-0"), (1.5, "1.5"), (100.0, "100"),
])
def test_float_text(x, text):
    assert node.float_text(x) == text


@pytest.mark.parametrize("text", ['{"a":1,"a":1}', '{"map":{"a":1,"a":2}}', "1.5", '{"float":"1","x":1}', '{"base64":"?"}', '{"cid":"bafy"}', "18446744073709551616", "tru", "NaN", "{}"])
def test_json_rejects(text):
    with pytest.raises(ValueError):
        node.from_json(text)


def test_json_strings_and_zero():
    assert node.to_json("\x00\n\x07\b\t\x0b\f\r\x0e\x7f") == '"\\u0000\\n\\u0007\\b\\t\\u000b\\f\\r\\u000e\x7f"'
    assert node.from_json("-0") == 0


@given(st.binary(max_size=40), st.sampled_from(sorted(multibase.BASES)))
def test_multibase(data, base):
    assert multibase.decode(multibase.encode(data, base)) == data


def test_multibase_padding():
    assert multibase.decode("mZh") == multibase.decode("mZg") == b"f"
    for bad in ("Zg", "mZg==", "MZg", "MZg=", "", "f0"):
        with pytest.raises(ValueError):
            multibase.decode(bad)


@given(st.integers(0, 2**56 - 1))
def test_varint(n):
    assert get_varint(put_varint(n), 0) == (n, len(put_varint(n)))


def test_order_follows_the_documents():
    values = [None, False, True, -5, 3, 2**63, -1.5, 2.0, "", "b", b"a", [1], [1, 2], {"b": 1}, {"aa": 0}]
    assert sorted(reversed(values), key=node.sort_key) == values


def test_names():
    for uri in ("/cid/uAXEAAQI", "/head/a/b%20c", "/call/f/uAXEAAQI,uAXEAAhgb"):
        assert names.parse_uri(uri).uri() == uri
    for bad in ("/head/", "/head/a/../b", "head/a", "/x/y", "/cid/zz"):
        with pytest.raises(ValueError):
            names.parse_uri(bad)
    assert names.query_parameters("/cid/x?a=1&b=%20") == [("a", "1"), ("b", " ")]
