"""Named queries over the standard tables, each with its SQL check where SQL can state it."""
