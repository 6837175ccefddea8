"""Column expressions and name rules shared by every operator."""
