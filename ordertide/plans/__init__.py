"""Tables, the query API and the registered queries."""
