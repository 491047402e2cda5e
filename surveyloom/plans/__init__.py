"""Result tables, built from the operators."""
