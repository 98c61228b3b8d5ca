"""The reports: which facts feed them, how facts are consolidated, and what each version outputs."""
