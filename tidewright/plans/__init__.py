"""Plan building blocks shared by the operators, and the eager interface."""
