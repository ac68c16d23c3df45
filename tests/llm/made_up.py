"""Made-up words for the tests of this folder."""
import zlib


def words(seed: int, n: int) -> list[str]:
    return [f"w{zlib.crc32(f'{seed} {i}'.encode()) % 4000}" for i in range(n)]
