import random


def words(seed: int, n: int, kinds: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(kinds)}x{draw.randrange(7)}" for _ in range(n))
