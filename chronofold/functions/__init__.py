"""Value kinds, coercions and time dimensions."""
