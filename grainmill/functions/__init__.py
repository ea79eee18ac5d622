"""Column expressions shared by all operators. Everything here stays JVM-side except
`similarity` and `distributions`, which hold the two pandas UDFs of the library."""
