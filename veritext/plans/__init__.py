"""Composite plans: the registered queries, their SQL oracles, and the
end-to-end flows."""
