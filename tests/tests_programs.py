"""PE files for tests."""

import struct


def program(plus, body, machine=0x14C, resources=0):
    """A PE file with a section of the body and one of 256 distinct bytes."""
    optional_size = 240 if plus else 224
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", machine, 2, 0, 0, 0, optional_size, 0x102)
    optional = struct.pack("<HBBIIIII", 0x20B if plus else 0x10B, 9, 200, 11, 12, 13, 14, 15)
    if plus:
        optional += struct.pack("<Q", 0xF000000000000001)
    else:
        optional += struct.pack("<II", 16, 0xFFEEDDCC)
    optional += struct.pack("<IIHHHHHHIIIIHH", 17, 18, 19, 20, 0, 0, 21, 22, 0, 0xC3A9C3A9, 24, 0, 2, 0x8160)
    optional += struct.pack("<QQQQII" if plus else "<IIIIII", 25, 26, 27, 28, 29, 16)
    directories = [0] * 32
    directories[5] = resources
    optional += struct.pack("<32I", *directories)
    assert len(optional) == optional_size
    data_at = 64 + 24 + optional_size + 80
    table = struct.pack("<8sIIII16x", b".text", len(body), 4096, len(body), data_at)
    table += struct.pack("<8sIIII16x", b"longname", 256, 8192, 256, data_at + len(body))
    return head + coff + optional + table + body + bytes(range(256))
