"""Plan building blocks: filters, collapsing before joins, ordered passes."""
