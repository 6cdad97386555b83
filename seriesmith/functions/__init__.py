"""Column builders: each returns a Column that Catalyst fuses with its neighbours."""
