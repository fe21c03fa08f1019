"""What is left on the accounts of providers. The call is the user's: nothing here reaches a network."""

from __future__ import annotations

from collections.abc import Callable


def parse(answer: dict) -> dict:
    """available, amount and currency of an answer; 0 and USD where it doesn't say."""
    first = next(iter(answer.get("balance_infos") or ()), {})
    return {"available": bool(answer.get("is_available")), "amount": float(first.get("total_balance") or 0), "currency": first.get("currency", "USD")}


class Balances:
    """Balances by provider, each asked for once; null where ``fetch`` has none or fails, whatever the failure."""

    def __init__(self, fetch: Callable[[str], dict | None]):
        self.fetch, self.known = fetch, {}

    def __call__(self, provider: str) -> dict | None:
        if provider not in self.known:
            try:
                answer = self.fetch(provider)
                self.known[provider] = None if answer is None else parse(answer)
            except Exception:
                self.known[provider] = None
        return self.known[provider]
