def thue_morse(n: int) -> tuple[str, str]:
    """The Thue-Morse word of n letters over a, b and its complement: hostile to hashes that are sums of powers."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
