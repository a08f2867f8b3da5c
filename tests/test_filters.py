import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.functions import crypto, filters
from inkwell.plans import codecs


def test_known_vectors():
    assert filters.lzw(bytes.fromhex("800b6050220c0c8501")) == b"-----A---B"
    assert filters.ascii85(b"9jqo^BlbD-BleB1DJ+*+F(f,q") == b"Man is distinguished"
    assert filters.ascii85(b"<~9jqo^~>") == b"Man " and filters.ascii85(b"zz") == bytes(8)
    assert filters.ascii_hex(b"61 62 2e6364   65>ff") == b"ab.cde" and filters.ascii_hex(b"7>") == b"p"
    assert filters.run_length(b"\x05123456\xfa7\x04abcde\x80junk") == b"1234567777777abcde"


@given(st.binary(max_size=2000))
def test_round_trips(data):
    assert filters.lzw(codecs.lzw(data)) == data
    assert filters.ascii85(codecs.ascii85(data)) == data
    assert filters.run_length(codecs.run_length(data)) == data
    padded = data.ljust(-(-len(data) // 7) * 7, b"\0")
    assert filters.png_predictor(codecs.png(data, 7), 1, 7, 8) == padded
    assert filters.tiff_predictor(codecs.tiff(data, 7), 1, 7, 8) == padded


def test_long_lzw_crosses_all_widths():
    data = bytes((i * i // 7) & 255 for i in range(60_000))
    assert filters.lzw(codecs.lzw(data)) == data


def test_damaged_flate_keeps_its_start():
    whole = codecs.flate(b"hello " * 1000)
    assert filters.flate(whole[:-4]) == b"hello " * 1000
    mixed = bytes((i * i // 7) & 255 for i in range(5000))
    start = filters.flate(codecs.flate(mixed)[:800])
    assert start and mixed.startswith(start)
    assert filters.flate(b"no zlib") == b""


def test_fax():
    assert filters.ccitt(bytes([0b11110000]), {"K": -1, "Columns": 8, "Rows": 4}) == b"\xff" * 4
    # horizontal: white run of 3, black run of 2, then to the end
    bits = "001" + "1000" + "11" + "1"
    data = int(bits.ljust(16, "0"), 2).to_bytes(2, "big")
    assert filters.ccitt(data, {"K": -1, "Columns": 8, "Rows": 1, "BlackIs1": True}) == bytes([0b00011000])
    with pytest.raises(filters.FilterFault):
        filters.ccitt(b"", {"K": 0})


def test_chain_and_unknown_filter():
    import zlib

    assert filters.decode(zlib.compress(b"abc").hex().encode() + b">", [("ASCIIHexDecode", {}), ("FlateDecode", {})]) == b"abc"
    assert filters.decode(b"jpeg", [("DCTDecode", {})]) == b"jpeg"
    with pytest.raises(filters.FilterFault):
        filters.decode(b"", [("Crypt", {})])


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for key, cipher in (("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089")):
        plain = bytes.fromhex("00112233445566778899aabbccddeeff")
        k = bytes.fromhex(key)
        assert crypto.aes_cbc(k, bytes(16), plain, encrypting=True).hex() == cipher
        assert crypto.aes_cbc(k, bytes(16), bytes.fromhex(cipher)) == plain
    assert crypto.unpad(b"abc" + b"\x05" * 5) == b"abc" and crypto.unpad(b"abc\x09") == b"abc\x09" and crypto.unpad(b"") == b""


def test_older_handler_accepts_both_passwords():
    import hashlib

    first_id, flags, n = b"0123456789abcdef", -44 & 0xFFFFFFFF, 16
    d = hashlib.md5((b"owner" + crypto.PADDING)[:32]).digest()
    for _ in range(50):
        d = hashlib.md5(d).digest()
    o = (b"user" + crypto.PADDING)[:32]
    for i in range(20):
        o = crypto.rc4(bytes(k ^ i for k in d[:n]), o)
    base = {"Filter": "Standard", "V": 2, "R": 3, "Length": 128, "O": o, "P": flags}
    probe = crypto.Handler.__new__(crypto.Handler)
    probe.owner, probe.flags, probe.first_id, probe.revision, probe.length, probe.clear_metadata = o, flags, first_id, 3, n, False
    key = probe._file_key(b"user")
    u = hashlib.md5(crypto.PADDING + first_id).digest()
    for i in range(20):
        u = crypto.rc4(bytes(k ^ i for k in key), u)
    full = base | {"U": u + bytes(16)}
    assert crypto.Handler(full, first_id, "user").key == crypto.Handler(full, first_id, "owner").key == key
    h = crypto.Handler(full, first_id, "user")
    assert h.decrypt(h.decrypt(b"secret", 7, 0), 7, 0) == b"secret" and h.extractable and not h.modifiable
    with pytest.raises(crypto.PasswordFault):
        crypto.Handler(full, first_id, "wrong")


@pytest.mark.parametrize("revision", [5, 6])
def test_newer_handler(revision):
    probe = crypto.Handler.__new__(crypto.Handler)
    probe.revision = revision
    key, salts = bytes(range(32)), (b"abcdefgh", b"ijklmnop")
    user = probe._hash(b"user", salts[0]) + salts[0] + salts[1]
    ue = crypto.aes_cbc(probe._hash(b"user", salts[1]), bytes(16), key, encrypting=True)
    owner = probe._hash(b"owner", salts[0], user) + salts[0] + salts[1]
    oe = crypto.aes_cbc(probe._hash(b"owner", salts[1], user), bytes(16), key, encrypting=True)
    spec = {"V": 5, "R": revision, "O": owner, "U": user, "OE": oe, "UE": ue, "P": -1, "StmF": "StdCF", "StrF": "StdCF", "CF": {"StdCF": {"CFM": "AESV3"}}}
    for password in ("user", "owner"):
        h = crypto.Handler(spec, b"", password)
        assert h.key == key
    body = b"text" + b"\x0c" * 12
    assert h.decrypt(b"\x01" * 16 + crypto.aes_cbc(key, b"\x01" * 16, body, encrypting=True), 1, 0) == b"text"
