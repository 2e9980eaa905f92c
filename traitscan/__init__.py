"""All-pairs linear association analytics and the relational tools around it, on Spark."""
