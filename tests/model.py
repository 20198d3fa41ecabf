"""The per-run rules one product at a time: what the set-based operators must equal."""

from decimal import Decimal


class Catalog:
    def __init__(self):
        self.products, self.prices, self.moves, self.status, self.stock = {}, [], [], {}, {}

    def run(self, run, seen):
        """``seen``: {url: (hash, price, availability)} of one run, in order."""
        for url, (digest, price, stock) in seen.items():
            old = self.products.get(url)
            kind = "new" if old is None else "updated" if old["hash"] != digest else "unchanged"
            self.status[url, run["no"]] = kind
            if old and old["price"] != price:
                self.prices.append((url, run["no"], old["price"], price))
            if old and old["stock"] != stock:
                self.moves.append((url, run["no"], old["stock"], stock))
            self.products[url] = {
                "hash": digest, "price": price, "stock": stock, "missing": 0, "since": None,
                "first": old["first"] if old else run["no"], "last": run["no"], "at": run["no"],
            }
        gone = 0
        if not run["limited"]:
            for url, p in self.products.items():
                if url in seen:
                    continue
                p["missing"] += 1
                p["at"] = run["no"]
                if p["missing"] >= run["threshold"]:
                    p["stock"] = "unavailable"
                    p["since"] = p["since"] if p["since"] is not None else run["no"]
                gone += p["stock"] == "unavailable"
        self.stock[run["no"]] = gone


def history(rng, runs, products):
    """Random runs and sightings: gaps, null prices, returns with equal content."""
    plan = [
        {"no": n, "limited": rng.random() < 0.25, "threshold": rng.randint(1, 3)}
        for n in range(1, runs + 1)
    ]
    seen = []
    for run in plan:
        empty = rng.random() < 0.1
        now = {}
        for p in range(products):
            if not empty and rng.random() < 0.5:
                price = rng.choice([None, Decimal("1.00"), Decimal("2.50")])
                now[f"u{p}"] = (rng.choice("ab"), price, rng.choice(["in_stock", "out_of_stock", None]))
        seen.append(now)
    return plan, seen
